"""Tesselon: evidence-backed retrieval and session analytics on PySpark."""
