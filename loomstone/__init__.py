"""loomstone: a Spark-native engine for document, record-linkage and retrieval queries."""
