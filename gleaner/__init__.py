"""Spark-native engine for curating recordings by behavioural diversity."""
