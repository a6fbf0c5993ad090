"""A PySpark-native engine that builds, searches and scores passage-retrieval benchmarks."""
