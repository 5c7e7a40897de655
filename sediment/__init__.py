"""sediment: a PySpark-native engine for document retrieval and conversation analytics."""
