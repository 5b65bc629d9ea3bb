"""Whole pipelines built from the operators."""

from themeweave.plans.compressor import TextCompressor, TextCompressorModel
from themeweave.plans.extractor import TopicExtractor, TopicModel

__all__ = ["TextCompressor", "TextCompressorModel", "TopicExtractor", "TopicModel"]
