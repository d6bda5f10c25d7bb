"""Labellers and their cache."""
