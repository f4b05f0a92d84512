"""codeloom: a Spark-native engine for code-graph analytics and training-data preparation."""

__version__ = "0.1.0"
