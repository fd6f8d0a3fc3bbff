"""A Spark-native analytics engine for multi-step generative evaluation."""
