"""kvspark: multi-version key/value data as Spark tables."""
