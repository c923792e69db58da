"""Official-statistics cells as Spark tables: read, tidy, check, load, query, search."""
