"""Spark-native analytics over decision logs of sequential association problems."""
