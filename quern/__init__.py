"""quern: a PySpark-native engine for retrieval, code-knowledge and log analytics."""
