from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

@pytest.fixture(scope="session")
def awkward():
    """``(doc_id, text)``: nulls, empty and very long texts, repeats, shared passages, odd characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéßñ,.") for _ in range(rng.randint(1, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = prose(70)
    texts = [
        None, "", " \n\t ", "one", "two words", "three words here", passage, passage, "x" * 350, "=" * 700,
        "ab" * 90 + "\n" + "ab" * 90, prose(6000) + " " + passage + "\n" + passage, "nul\x00byte " * 30, " non breaking " * 40,
    ]
    base = prose(120)
    for k in range(12):
        mine = base.split()
        mine[(k * 11) % len(mine)] = f"edit{k}"
        texts += [" ".join(mine), prose(30) + " " + passage + " " + prose(30), prose(rng.randint(1, 60))]
    texts += [base, base.upper(), base.replace(" ", "  "), "line one is here\n" * 8 + prose(40)]
    return list(enumerate(texts))
