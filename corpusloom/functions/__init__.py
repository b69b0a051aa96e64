"""Column functions and helpers shared by the operators."""
