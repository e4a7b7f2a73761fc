"""Tables to query: catalogues over files, and generated rows."""
