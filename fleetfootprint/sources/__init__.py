"""Readers and writers: explicit schemas, many files in one scan."""
