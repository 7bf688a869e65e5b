"""ledgerlens: a PySpark-native engine for multimodal case evidence."""

__version__ = "0.1.0"
