"""Barloom: a Spark-first analytics engine for daily market bars and text corpora."""
