"""sedimenta: a versioned, ordered key-value table and query layer on PySpark."""
