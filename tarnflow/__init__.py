"""Spark-native analytics for multi-site streamflow series and their synthetic ensembles."""
