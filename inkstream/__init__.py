"""Document-operations analytics as DataFrame-in / DataFrame-out Spark operators."""

__version__ = "0.1.0"
