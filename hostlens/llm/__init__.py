"""Operators for large training corpora (documents, pages, vectors, conversations)."""
