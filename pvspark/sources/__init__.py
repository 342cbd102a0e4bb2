"""Readers, payload decoding and stage files."""
