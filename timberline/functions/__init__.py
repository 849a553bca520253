"""Column builders: each takes columns or driver constants and returns a Column."""
