"""quern: a Spark-first engine for question-answering data, retrieval and corpus preparation."""

__version__ = "0.1.0"
