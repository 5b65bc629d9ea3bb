"""Plain-Python models of the text and topic stages, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter


def tokens(text: str) -> list[str]:
    return re.findall(r"(?u)\b\w\w+\b", text)


def terms(text: str, lowercase=True, stopwords=(), ngram_range=(1, 1)) -> list[str]:
    words = [w for w in tokens(text.lower() if lowercase else text) if w not in stopwords]
    low, high = ngram_range
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def topic_words(docs, num_words, **options) -> list[list[tuple[str, float]]]:
    """``docs`` are ``(text, label)`` in order; topics follow the first use of a label."""
    corpus, clusters = Counter(), {}
    for text, label in docs:
        found = terms(text, **options)
        corpus.update(found)
        clusters.setdefault(label, Counter()).update(found)
    return [
        sorted(((t, f / math.sqrt(corpus[t])) for t, f in counts.items()), key=lambda x: -x[1])[:num_words]
        for counts in clusters.values()
    ]


def doc_scores(texts, topics) -> list[list[float]]:
    lookups = [dict(topic) for topic in topics]
    return [[sum(lookup.get(t, 0.0) for t in tokens(text)) for lookup in lookups] for text in texts]
