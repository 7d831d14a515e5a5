"""Column-level helpers: expressions in, expressions out."""
