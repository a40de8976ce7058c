"""A Spark-native engine for immutable, self-describing, content-hashed scientific data products."""

__version__ = "0.1.0"
