"""Readers and writers of the domain tables."""
