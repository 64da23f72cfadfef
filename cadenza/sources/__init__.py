"""Readers and writers of frame files."""
