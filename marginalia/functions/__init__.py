"""Column expressions and Arrow-batched helpers."""
