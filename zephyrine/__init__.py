"""A PySpark-native analytics engine: relational queries, JSON, vectors, versioned tables and change streams."""
