"""A Spark engine for hybrid retrieval over collections of text notes."""
