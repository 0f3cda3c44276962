"""codescout: code search, hybrid retrieval and graph analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
