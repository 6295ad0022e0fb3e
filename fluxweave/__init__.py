"""fluxweave: a PySpark-native engine for radio-continuum source finding."""

__version__ = "0.1.0"
