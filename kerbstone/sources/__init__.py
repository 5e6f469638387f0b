"""Readers and writers of the canonical formats."""
