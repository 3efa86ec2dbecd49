"""Column expressions shared by all operators and the fixed rule tables."""
