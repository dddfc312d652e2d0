"""Whole jobs: curation of clips, masks of cameras, and their command line."""
