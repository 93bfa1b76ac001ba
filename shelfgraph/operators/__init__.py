"""Relational, text, similarity and graph operators as DataFrame functions."""
