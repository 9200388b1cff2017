"""Column-level building blocks. Every function takes and returns Spark columns."""
