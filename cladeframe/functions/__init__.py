"""Column expressions and keyed helpers shared by the operators."""
