"""plinth: a Spark-native engine for drawing tables, schedule reconstruction and corpus preparation."""
