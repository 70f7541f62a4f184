"""marlspike: retrieval, document analytics and data preparation written as Spark plans."""

__version__ = "0.1.0"
