"""Spark jobs for document corpora and the retrieval systems built on them."""
