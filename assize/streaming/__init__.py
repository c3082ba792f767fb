"""Answers as they arrive."""
