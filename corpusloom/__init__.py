"""A Spark engine for label-rich document corpora."""
