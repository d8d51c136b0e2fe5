"""The registered queries: operators applied to the given tables."""
