"""sheafline: a PySpark-native engine for mixed collections of sheets and documents."""

__version__ = "0.1.0"
