"""Spark jobs that find, resolve, mask, restore and evaluate personal data in large tables and streams of text."""
