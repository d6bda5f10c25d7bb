"""Readers with explicit schemas, and writers."""
