"""A Spark-native engine that finds, validates, summarises and redacts personal data in text columns."""
