import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm.text import arrow_words, split_batch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def expected(texts):
    found = [WORD.findall(fold(t)) for t in texts]
    return [w for f in found for w in f], [len(f) for f in found]


TEXTS = ["", None, " \t\x0b\x0c\r\n ", "Élan  VITAL\x1cx", "a", " b c\x85d ", "Ünï　codé A" * 50, "x" * 5000]


def test_words():
    flat, counts = arrow_words(pa.array(TEXTS))
    assert (flat.to_pylist(), counts.tolist()) == expected(TEXTS)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_slices(kind):
    rng = random.Random(1)
    texts = [rng.choice(TEXTS) for _ in range(300)]
    whole = pa.array(texts, kind)
    for _ in range(30):
        a = rng.randrange(300)
        n = rng.randrange(300 - a + 1)
        flat, counts = arrow_words(whole.slice(a, n))
        flat.validate(full=True)
        assert (flat.to_pylist(), counts.tolist()) == expected(texts[a : a + n])


def test_split_batch_keeps_every_row():
    texts = ["é" * n for n in (0, 5, 50, 5000, 1, 1, 9000)] + [None]
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "text": pa.array(texts)})
    parts = list(split_batch(batch, "text", 100))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(8))
    got = [arrow_words(p.column("text")) for p in parts]
    assert [w for f, _ in got for w in f.to_pylist()] == expected(texts)[0]
    assert np.concatenate([c for _, c in got]).tolist() == expected(texts)[1]
