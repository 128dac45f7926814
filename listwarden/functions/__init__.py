"""Column expressions that rules are made of."""
