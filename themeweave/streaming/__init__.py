"""Scoring documents as they arrive."""

from themeweave.streaming.scoring import score_stream

__all__ = ["score_stream"]
