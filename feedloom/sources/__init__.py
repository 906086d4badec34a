"""Readers, the catalog, version decisions and writers."""
