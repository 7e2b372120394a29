"""corpusloom: a PySpark-native engine for document retrieval, answer verification and corpus preparation."""
