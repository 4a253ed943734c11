"""loomline: a Spark-native engine that correlates log and metric streams."""
