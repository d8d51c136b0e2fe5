"""Column expressions and table helpers shared by the operators."""
