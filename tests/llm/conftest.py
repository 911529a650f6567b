"""Small fixtures for the training-data operators."""

import random

import pytest

#: Names that the operators use inside; as extra columns they must not matter.
CLASH = ("row", "rank", "key", "place", "score", "predicted", "n_lines", "n_removed", "_id", "_gone", "host",
         "region", "size", "part", "n_words", "kept", "runs", "sequence_id")


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of (doc_id, text) pairs, with clashing extra columns."""
    def make(pairs, clash=True):
        rows = [(i, t, "en", f"src{k % 3}", len(t or "")) + (("x",) * len(CLASH) if clash else ())
                for k, (i, t) in enumerate(pairs)]
        names = "doc_id long, text string, lang string, source string, n_chars long"
        if clash:
            names += "".join(f", `{c}` string" for c in CLASH)
        return spark.createDataFrame(rows, names)
    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded text of invented words."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(4000)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))
    return make
