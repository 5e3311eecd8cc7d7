"""Operators over long coordinate tables."""
