"""Blob readers and writers."""
