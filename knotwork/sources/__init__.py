"""Readers and writers for triples, vectors and result tables."""
