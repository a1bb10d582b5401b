"""Safe copies of production data on Spark: mask, verify, discover, subset, snapshot, audit."""
