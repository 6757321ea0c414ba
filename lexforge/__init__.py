"""lexforge: a Spark-native engine for building, auditing and querying a document corpus."""
