"""Whole index builds and their jobs."""
