"""moodtide: post-stream and sentiment-series analytics as composable PySpark DataFrame operators."""
