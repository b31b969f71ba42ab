"""Spark-native normalisation, matching and fusion of place-like records."""
