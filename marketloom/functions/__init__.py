"""Column -> Column helpers. Everything here is a native expression: no Python UDF."""
