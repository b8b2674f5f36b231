"""Column expressions: scalars, label rules and geometry."""
