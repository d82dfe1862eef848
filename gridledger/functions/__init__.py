"""Column builders. Each takes columns and returns a column; none of them touches data."""
