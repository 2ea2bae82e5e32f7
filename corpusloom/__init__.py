"""A PySpark-native engine for document-corpus analytics."""
