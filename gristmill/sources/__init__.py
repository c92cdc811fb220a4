"""Readers and writers for corpora, packed shards, run logs and results."""
