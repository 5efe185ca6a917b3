"""Readers: archives, catalogue databases, completions and embeddings."""
