"""Readers, writers and the declared table schemas."""
