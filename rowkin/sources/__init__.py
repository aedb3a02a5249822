"""Readers and writers of tab-separated tables."""
