"""Spark-native nonlinear time-series analytics and data-preparation operators."""
