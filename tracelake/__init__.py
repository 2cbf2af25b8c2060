"""tracelake: a Spark-native engine for evidence-backed network analytics."""

__version__ = "0.1.0"
