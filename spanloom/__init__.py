"""Timeline analytics on Spark: operators over instants, intervals, labels and vectors."""

__version__ = "0.1.0"
