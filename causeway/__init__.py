"""A PySpark engine that turns collections of discourse into signed causal maps."""
