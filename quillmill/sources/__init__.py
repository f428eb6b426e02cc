"""Readers: parquet corpora, directory trees, git change sets, configuration."""
