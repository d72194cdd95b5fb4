"""quarry: a Spark-first engine for document retrieval, its evaluation and its corpora."""
