"""Spark-native analytics for text provenance: features, fusion, cohort analytics and stores."""

__version__ = "0.1.0"
