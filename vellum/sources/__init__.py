"""Readers for manuscripts, term lists and trees of files, and report sinks."""
