"""custaris: Spark-native customer analytics (profiling, features, models, scoring, drift)."""
