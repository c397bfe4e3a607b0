"""Relational operators on segments, rectangles, caches and reports."""
