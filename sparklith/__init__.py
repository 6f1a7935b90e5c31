"""sparklith: columnar expressions, hash partitioning and joins, planned and run by Spark."""
