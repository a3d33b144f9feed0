"""Column builders shared by the operator families."""
