"""Spark-native memory analytics: retrieval, temporal facts, decay, graphs and text analytics as DataFrame functions."""
