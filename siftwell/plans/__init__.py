"""Whole query plans over several tables."""
