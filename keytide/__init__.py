"""keytide: a PySpark-native engine for versioned key-value change logs."""

__version__ = "0.1.0"
