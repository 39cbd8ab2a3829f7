"""Content-based ranking of one table's items against another table's, on Spark."""
