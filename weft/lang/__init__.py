"""The schema and query languages: tokens, syntax trees, parsers and a printer."""
