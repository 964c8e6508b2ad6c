"""A PySpark-native engine for typed property graphs of source code."""
