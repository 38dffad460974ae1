"""Column expressions: calendar buckets, text rules, small arrays."""
