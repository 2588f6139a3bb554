"""Column expressions: units, cell parsing, the normal quantile."""
