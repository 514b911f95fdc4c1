"""Spark-native numerical analytics: matrices, tables, text, time and files as lazy DataFrame plans."""
