"""Readers, writers and materialisation points."""
