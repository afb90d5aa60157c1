"""A Spark-native engine for gridded, time-stamped and angular measurement data."""
