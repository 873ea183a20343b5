"""Millrace: a Spark-native engine for preparing, profiling and scoring language-model training data."""
