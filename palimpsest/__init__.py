"""Palimpsest: review and redaction of sensitive data, and training-data preparation, as Spark jobs."""
