"""Corpora in, results out."""
