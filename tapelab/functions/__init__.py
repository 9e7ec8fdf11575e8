"""Column expressions: no actions, no Python on the executors."""
