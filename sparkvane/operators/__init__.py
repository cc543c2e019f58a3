"""The corpus, searches over it, exclusion sets, ranking and grouping."""
