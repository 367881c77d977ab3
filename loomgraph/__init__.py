"""A Spark-native code-graph and context-retrieval engine."""
