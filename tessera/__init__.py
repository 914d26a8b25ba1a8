"""Spark-native raster, label and corpus analytics."""
