"""gneiss: column profiling of large tables on Spark, one scan per table."""

__version__ = "0.1.0"
