"""Topic extraction over corpus tables, as Spark DataFrame operators."""

from themeweave.functions.text import TextOptions
from themeweave.plans import TextCompressor, TextCompressorModel, TopicExtractor, TopicModel

__all__ = ["TextCompressor", "TextCompressorModel", "TextOptions", "TopicExtractor", "TopicModel"]
