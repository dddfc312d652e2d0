"""Relational operators over embeddings, frames and masks."""
