"""Readers and writers of sequence, alignment, interval and edge files."""
