"""Tesserae: indexing, ranking and cleaning of file and document collections on Spark."""
