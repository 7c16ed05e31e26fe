"""The Jaccard join on crowds: form letters that share most of their tokens, linked or not."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenforge.llm import jaccard_join
from lumenforge.llm.hashing import Powers


def letters(n: int, own: int, seed: int = 1, length: int = 400) -> list[str]:
    rng = random.Random(seed)
    form = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(length)]
    out = []
    for i in range(n):
        w = form[:]
        for at in rng.sample(range(length), own):
            w[at] = f"own{i}x{at}"
        out.append(" ".join(w))
    return out


def brute(texts: list[str]) -> dict[int, int]:
    powers = Powers()
    sets = [jaccard_join.shingle_set(t, powers) for t in texts]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if find(i) != find(j) and jaccard_join.linked(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(sets))}


def components(spark, texts: list[str]) -> dict[int, int]:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}


def test_unlinked_form_letters_leave_few_rows(spark, monkeypatch):
    told = []
    for name in ("crossing", "crowded_pairs"):
        plain = getattr(jaccard_join, name)

        def counted(*args, plain=plain, name=name):
            out = plain(*args)
            told.append((name, out.distinct().count()))
            return out

        monkeypatch.setattr(jaccard_join, name, counted)
    for n in (400, 800):
        told.clear()
        texts = letters(n, 7)
        got = components(spark, texts)
        assert got == brute(texts) and len(set(got.values())) > 0.95 * n
        assert {k for k, _ in told} == {"crossing", "crowded_pairs"} and sum(c for _, c in told) <= n / 4


@pytest.mark.parametrize("few", [0, 16])
def test_crowds_equal_brute_force(spark, monkeypatch, few):
    """Letters around the threshold, in small blocks, and with keys of any size in blocks."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 1)
    texts = letters(60, 4) + letters(60, 5, seed=2) + letters(30, 7, seed=3) + [t + " " + " ".join(f"more{i}{k}" for k in range(i)) for i, t in enumerate(letters(40, 5, seed=2))]
    random.Random(4).shuffle(texts)
    assert components(spark, texts) == brute(texts)


@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 40)), min_size=1, max_size=12), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_bitmaps_never_lose_a_link_and_lose_few_bits(shapes, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([pool[:n], rng.integers(0, 1 << 63, more).astype(np.uint64)])) for n, more in shapes]
    maps, sizes = [jaccard_join.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    got = jaccard_join.possible_links((maps, sizes), (maps, sizes))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            common = len(np.intersect1d(a, b))
            if jaccard_join.linked(a, b):
                assert got[i, j]
            elif common < 0.7 * (len(a) + len(b) - common):
                assert not got[i, j] or len(a) + len(b) < 60


class Tasks:
    """Takes the place of a table and keeps the functions that tasks run."""

    def __init__(self, spark, schema):
        self.sparkSession, self.schema, self.run = spark, schema, []

    def select(self, *columns):
        return self

    repartition = select

    def mapInArrow(self, function, schema):
        self.run.append(function)
        return self


def test_subsets_are_gathered_in_portions(spark, monkeypatch):
    """Tasks send and meet subsets in portions, so that their memory doesn't grow with them; no common subset is lost."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    texts = [" ".join([*base[i % 5 : 400 + i % 5], *(f"v{rng.randrange(10**6)}" for _ in range(i % 40))]) for i in range(120)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(2_000)) for _ in range(400)]
    docs = pa.table({"doc_id": range(len(texts)), "text": texts})
    tasks = Tasks(spark, spark.range(0).withColumnRenamed("id", "doc_id").schema)
    jaccard_join.shared_subsets(tasks, "doc_id", "text", 5)
    emit, meet = tasks.run

    def groups(portion):
        monkeypatch.setattr(jaccard_join, "GATHERED", portion)
        sent, members = [], {}
        tracemalloc.start()
        for half in (docs.slice(0, 60), docs.slice(60)):
            sent += emit(iter(half.to_batches(max_chunksize=40)))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        shared = ["key", "a", "b"]
        for rows in [*(b.select(shared) for b in sent), *(b.select(shared) for b in meet(iter(sent)))]:
            for r in rows.to_pylist():
                if r["key"] is not None:
                    members.setdefault(r["key"], set()).update((r["a"], r["b"]))
        return members, peak

    many, low = groups(1 << 15)
    whole, high = groups(1 << 40)
    assert many == whole and len(many) > 100 and low < 0.7 * high
