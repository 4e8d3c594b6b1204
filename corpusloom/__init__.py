"""corpusloom: a Spark-native engine for transcript corpora, retrieval and evaluation."""

__version__ = "0.1.0"
