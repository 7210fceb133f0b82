"""A Spark-native scanner for exposed secrets and endpoints in tables of web pages and text."""
