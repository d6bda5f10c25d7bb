"""Exact small-sample statistics over aggregated counts."""
