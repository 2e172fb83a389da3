"""A PySpark-native engine for receipt interpretation, scoring and log analytics, and for training-data pipelines."""
