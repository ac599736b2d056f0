"""Part of casegraph, a PySpark-native engine for case records and person graphs."""
