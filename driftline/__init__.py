"""driftline: a Spark-native tabular-pipeline, drift and operations-analytics engine."""

__version__ = "0.1.0"
