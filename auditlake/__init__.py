"""A Spark-native engine that audits source, pages and documents as relations."""

__version__ = "0.1.0"
