"""lexloom: Spark-native text analytics for grammar-driven language processing."""

__version__ = "0.1.0"
