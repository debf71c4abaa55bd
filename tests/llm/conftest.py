"""Small document tables for the text operators' tests."""

import os
import random

import pytest

SF = "/root/testdata/sf0.001"
#: Documents' columns, and more whose names operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, text_sha256 string, node long, row long, bucket int, piece int, spans string, base string, keep_id long, y int, part int"
ODD = [None, "", " ", "a", "\n\t\n", "é ß 漢字   x", "word " * 5, "tie tie", "tie tie", "<|endoftext|> </s>", "a\0b", "\x0b\x0c\x1f", "w" * 3000]


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text) pairs, or from texts numbered from 0."""

    def made(rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, *[None] * 14) for i, t in pairs], COLUMNS)

    return made


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies in chains, shared passages and odd cases."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    out, passage = [], " ".join(text(60))
    for _ in range(12):
        own = text(rng.randint(40, 120))
        out.append(" ".join(own))
        for _ in range(rng.randint(0, 6)):
            own = list(own)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own).upper() if rng.random() < 0.3 else "  ".join(own))
    out += [f"{' '.join(text(10))} {passage} {' '.join(text(10))}" for _ in range(4)]
    return out + ODD + ["a b c", "A b  C"]
