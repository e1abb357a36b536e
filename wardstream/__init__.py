"""A Spark-native engine for security telemetry and the labelled datasets built from it."""
