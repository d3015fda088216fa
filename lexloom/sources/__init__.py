"""Readers and writers of articles, chunks and index tables."""
