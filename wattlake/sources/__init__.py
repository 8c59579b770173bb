"""Readers, document flattening and writers."""
