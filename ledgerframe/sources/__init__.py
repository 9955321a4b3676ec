"""Change-log storage: Parquet batches under a versioned manifest."""
