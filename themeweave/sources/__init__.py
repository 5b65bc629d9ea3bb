"""Inputs: a corpus of documents, and rows of uniform noise."""

from themeweave.sources.corpus import corpus_scan, noise_rows

__all__ = ["corpus_scan", "noise_rows"]
