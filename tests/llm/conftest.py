from __future__ import annotations

import random

import pytest

#: Columns that share names with the operators' own.
CLASHES = ["_id", "_text", "n", "node", "size", "_rank", "h", "doc", "kept", "root", "copies", "_bucket", "score", "text_sha256"]


@pytest.fixture(scope="session")
def frame(spark):
    """Makes documents of (doc_id, text, lang, source) with clashing columns besides, over some partitions."""

    def make(rows, partitions: int = 3):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)
        full = [(d, t, lang, source, None if t is None else len(t), *(["x"] * len(CLASHES))) for d, t, lang, source in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


def prose(rng: random.Random, n: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and blank and very long texts, exact, near and partial copies, repeated rows and ids."""
    rng = random.Random(11)
    base, other = prose(rng, 220), prose(rng, 90)
    words = base.split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    rows = [
        (1, base, "en", "a"),
        (2, base.replace(" ", "\n", 3) + " ", "en", "b"),
        (3, near, "en", None),
        (4, None, "en", "a"),
        (5, "", None, "a"),
        (6, " \t\n", "en", "c"),
        (7, "one", "en", "c"),
        (8, "One", "de", "c"),
        (9, other, "de", "b"),
        (9, other, "de", "b"),
        (10, other + " " + base, "de", "b"),
        (11, "x", None, None),
        (11, prose(rng, 30), "fr", "b"),
        (None, base, "en", "a"),
        (None, None, None, None),
        (12, prose(rng, 30_000), "en", "a"),
        (13, "l'été à l'école, é\U0001f600 " * 30, "fr", "d"),
        (14, "a" * 50_000, "en", "d"),
        (15, "y " * 400, "en", "d"),
    ]
    return rows
