"""mustra: a PySpark-native cohort analytics engine."""

__version__ = "0.1.0"
