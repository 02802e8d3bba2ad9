"""lexmill: corpus curation, retrieval and evaluation as Spark DataFrame transformations."""
