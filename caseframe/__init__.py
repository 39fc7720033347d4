"""caseframe: Spark-native analytics over logs, file metadata, captures and recovered text."""
