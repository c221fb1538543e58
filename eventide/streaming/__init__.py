"""Continuous forms of the batch operators."""

from .live import live_counts, live_document_frequencies, live_single_pass

__all__ = ["live_counts", "live_document_frequencies", "live_single_pass"]
