"""Reads as they arrive: the row-wise operators on streams of files."""
