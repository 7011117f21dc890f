"""tarnspark: a Spark-native nearest-neighbour scoring engine."""

__version__ = "0.1.0"
