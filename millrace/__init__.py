"""millrace: a PySpark-native engine for ingesting, matching and scoring text records."""
