"""tracklab: Spark-native evaluation of competing models on long sensor recordings."""
