"""Column functions of the evidence engine."""
