"""Column -> Column building blocks; every one is a native Spark expression."""
