"""Spark jobs that find and mask personal data in large collections of text."""
