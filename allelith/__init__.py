"""Spark-native genotyping and variant-table analytics."""
