"""quillmill: a Spark-native engine that turns text and code corpora into ranked, redacted, size-bounded context."""

__version__ = "0.1.0"
