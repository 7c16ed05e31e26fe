"""What tasks of the corpus operators hold at a time, and leave in their Python workers."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from lumenforge.llm import common, toxicity


def test_trigrams_are_counted_in_portions():
    words = Counter({f"{i:06d}word": i % 7 + 1 for i in range(100_000)})
    tracemalloc.start()
    got = toxicity._trigrams(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6
    few = Counter(dict(list(words.items())[:500]) | {"œuf": 3, "a": 2})
    sym = {c: i + 1 for i, c in enumerate(toxicity.LETTERS)}
    want = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for w, n in few.items():
        codes = [0, 0, *(sym.get(c, toxicity.OTHER) for c in w), 0, 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):  # noqa: B905
            want[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS + c] += n
    for portion in (1, 7, 16_384):
        assert (toxicity._trigrams(few, portion) == want).all()
    assert got.sum() == sum(n * (len(w) + 2) for w, n in words.items())
    assert not toxicity._trigrams(Counter()).any()


def test_batches_end_by_bytes(spark):
    common.arrow_rows(spark)
    rows = spark.range(0, 120, 1, 1).selectExpr("id", "repeat('x', 200000) text")

    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "held"])

    got = rows.mapInArrow(told, "n bigint, held bigint").collect()
    assert sum(r.n for r in got) == 120
    assert max(r.held for r in got) < common.BATCH_BYTES + 1_000_000


def test_tasks_give_back(monkeypatch):
    seen = []

    class Pool:
        def release_unused(self):
            seen.append("back")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)

    @common.giving_back
    def run(batches):
        for b in batches:
            seen.append(b)
            yield b

    assert list(run(iter([1, 2]))) == [1, 2]
    assert seen == [1, 2, "back"]
