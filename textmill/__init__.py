"""A PySpark-native engine for structured-document processing and text quality."""
