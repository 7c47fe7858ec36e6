"""readpool: a Spark-native engine for clustering pools of noisy sequence reads."""
