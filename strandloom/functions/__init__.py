"""Column expressions over DNA strings and the batched alignment kernel."""
