"""Spark-native analytics over infrastructure-as-code facts."""
