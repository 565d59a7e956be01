"""Scoring of texts: what a scorer is, and one that is trained here."""
