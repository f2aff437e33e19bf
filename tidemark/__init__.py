"""tidemark: a PySpark-native engine for honest time-series analytics."""
