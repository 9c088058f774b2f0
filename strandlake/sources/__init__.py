"""Readers and writers of sequence, taxonomy and classification files."""
