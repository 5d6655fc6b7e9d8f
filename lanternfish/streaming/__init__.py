"""Event contracts, throttles and batches, on streams and on tables."""
