"""quillmill: a Spark-first engine for building and curating instruction and training data."""

__version__ = "0.1.0"
