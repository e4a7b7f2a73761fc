"""Planning: predicates to columns, selections and mutations to DataFrames."""
