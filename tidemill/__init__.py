"""Tidemill: Spark-native analytics for ordered bar series (and, in ``llm``, for text corpora)."""
