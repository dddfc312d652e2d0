"""Readers and writers: frames, videos, configuration, embeddings, masks."""
