"""Whitening, the conversation trie and the piece codec against exact and plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenforge.llm import conversation_trie, piece_codec, queries, whitening

# Piece codec


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Codec(piece_codec.default_model())


@given(st.lists(st.sampled_from([*"ab etho.,'\"\n\t▁ö梦🧿1́\x00()[]-", " the", "  "]), max_size=60).map("".join))
@settings(max_examples=300, deadline=None)
def test_agenda_equals_library_on_any_text(codec, text):
    ids, agrees = codec.encode([text])[0]
    assert ids == codec.library.encode(text, add_eos=True) and agrees


def test_agenda_on_long_runs_and_all_of_unicode(codec):
    rng = random.Random(2)
    anything = "".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30_000))
    for text in ("a" * 50_000, "ab" * 30_000, " " * 20_000 + "x", "a.b" * 20_000, anything):
        assert codec.encode([text])[0][0] == codec.library.encode(text, add_eos=True)


def test_agenda_merges_the_leftmost_of_equal_scores():
    assert piece_codec.merged("aaa", {"aa": -1.0}) == ["aa", "a"]
    assert piece_codec.merged("abc", {"ab": -2.0, "bc": -1.0, "abc": -3.0}) == ["abc"]
    assert piece_codec.merged("", {}) == []


def test_a_wrong_part_is_told(codec):
    own = piece_codec.Codec(piece_codec.default_model())
    own.scores = {k: v for k, v in own.scores.items() if k != "▁the"}
    assert own.encode(["the house", "of"])[0][1] is False and own.encode(["of"])[0][1] is True


def test_parts_are_forgotten_when_there_are_too_many(monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT", 200)
    own = piece_codec.Codec(piece_codec.default_model())
    rng = random.Random(4)
    for _ in range(20):
        text = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(30))
        assert own.encode([text])[0][0] == own.library.encode(text, add_eos=True)
    assert len(own.kept) < 200


def test_encode_keeps_columns_and_defines_nulls(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, "", None), (2, "Hello  there\n", "y"), (None, "Hello  there\n", "y")], "doc_id long, text string, pieces_ string")
    out = piece_codec.encode(rows).select("doc_id", "text", "pieces_", "pieces.*").collect()
    assert [(r.ids, r.decoded, r.agrees) for r in out[:2]] == [([2], "", True)] * 2
    assert out[2].ids == out[3].ids and out[2].decoded == "Hello  there\n" and out[2].ids[-1] == 2
    assert piece_codec.encode(rows.limit(0)).count() == 0


def test_query_of_all_documents(spark, codec):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op13_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = codec.library.encode(docs[r.doc_id], add_eos=True)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (len(ids), sha(" ".join(map(str, ids))), sha(codec.library.decode(ids)), True)


# Whitening


def exact_whitening(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred @ u[:, ::-1] / np.sqrt(e[::-1]), e[::-1] / e.sum()


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    deviation, white, share = exact_whitening([r.embedding for r in rows])
    at = {r.vec_id: i for i, r in enumerate(rows)}
    got = queries.op11_whitening(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 32 * len(rows)
    values = np.zeros((len(rows), 32))
    for r in got:
        assert r.deviation == deviation[at[r.vec_id]] and r.n == len(rows) and r.identity_error < 1e-9
        assert abs(r.explained - share[r.component - 1]) < 1e-12
        values[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((values * white[:, :32]).sum(axis=0))
    assert np.abs(values * sign - white[:, :32]).max() < 1e-8


@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=3, max_size=3), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_limb_products_are_exact(rows):
    x = np.array(rows, np.int64)
    sums = np.zeros((whitening.PLACES, 3, 3), np.int64)
    for i in range(0, len(x), 7):
        whitening.add_products(sums, x[i : i + 7])
    for i in range(3):
        for j in range(3):
            assert sum(int(sums[p, i, j]) << (whitening.LIMB * p) for p in range(whitening.PLACES)) == sum(a[i] * a[j] for a in rows)


def test_whitening_of_bad_repeated_flat_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>, white int"
    nan, inf = float("nan"), float("inf")
    bad = [(1, [1.0, 2.0, nan], 1), (2, None, 1), (3, [1.0, None, 2.0], 1), (4, [1.0], 1), (9, [1.0, 1.0, inf], 1)]
    good = [(5, [0.5, 1.0, 2.0], 1), (6, [0.5, 1.0, 3.0], None), (None, [0.7, 1.0, 3.5], 1), (8, [0.7, 1.0, 3.5], 1), (8, [0.7, 1.0, 3.5], 1)]
    got = whitening.components(spark.createDataFrame(bad + good, schema), "vec_id").collect()
    assert len(got) == 15 and {r.n for r in got} == {5}
    assert all((r.whitened is None) == (r.component == 3) for r in got) and all(r.identity_error < 1e-9 for r in got)
    x = [[math.floor(64 * np.float32(c).item()) + 1_000_000 for c in v] for _, v, _ in good]
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = sorted(sum((5 * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x)
    assert sorted(r.deviation for r in got if r.component == 1) == deviation
    huge = whitening.components(spark.createDataFrame([(1, [1e30, 1.0], 1), (2, [1.0, 5.0], 1), (3, [3.0, -1e20], 1)], schema), "vec_id").collect()
    assert len(huge) == 6 and all(r.deviation is None and r.identity_error < 1e-9 for r in huge)
    assert [(r.whitened, r.explained) for r in whitening.components(spark.createDataFrame([(1, [1.0, 2.0], 1)], schema), "vec_id").collect()] == [(None, None)] * 2
    assert whitening.components(spark.createDataFrame(bad[:2] + bad[4:], schema), "vec_id").count() == 0
    assert whitening.components(spark.createDataFrame([], schema), "vec_id").count() == 0


# Conversation trie


def nodes(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == k)
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check_trie(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "conv_id long, turn long, role string, text string, n int, path string, value long")
    assert sorted((tuple(r) for r in conversation_trie.conversation_trie(df).collect()), key=str) == nodes(rows)


@pytest.mark.parametrize("seed", range(4))
def test_trie_of_any_conversations(spark, seed):
    rng, rows = random.Random(seed), []
    for c in range(-20, (30, 60, 120, 200)[seed]):
        if rng.random() < 0.8:
            for k in range(rng.randint(1, rng.choice([3, 8, 15]))):
                rows.append((c, rng.choice([k, k, None]), rng.choice(["u", "a", None]), rng.choice(["x", "y", "é", ""]) if rng.random() < 0.6 else "x"))
    rng.shuffle(rows)
    check_trie(spark, rows)


def test_trie_of_one_of_turnless_and_of_equal_conversations(spark):
    check_trie(spark, [(1, 0, "u", "x")])
    check_trie(spark, [(4, 0, "u", "x"), (None, 0, "u", "x")])
    check_trie(spark, [(7, None, None, None), (7, None, "u", "b"), (7, 1, "é", "ü")])
    check_trie(spark, [(c, k, "u", "same") for c in range(300) for k in range(12)])
    check_trie(spark, [(5, k, "u", f"{k % 3}" * 50) for k in range(400)] + [(10, k, "u", f"{k % 3}" * 50) for k in range(390)])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie.conversation_trie(empty).count() == 0


def test_a_large_group_of_ends_is_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 50)
    paths = spark.range(2000).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("path"))
    got = {r.id: r.ends for r in conversation_trie.ends(paths).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {0: sha(range(0, 2000, 3)), 1: sha(i for i in range(2000) if i % 3)}


def test_agendas_of_both_kinds(codec, monkeypatch):
    """Short parts have a list for an agenda, longer ones a heap; what is kept of parts is packed."""
    rng = random.Random(7)
    parts = ["".join(rng.choices("▁thehanindeßreaé,1", k=rng.randint(0, piece_codec.FEW))) for _ in range(400)]
    listed = [piece_codec.merged(p, codec.scores) for p in parts]
    ties = {"aa": -1.0, "ab": -1.0, "ba": -1.0, "aab": -1.0, "aba": -2.0}
    odd = ["".join(rng.choices("ab", k=12)) for _ in range(200)]
    tied = [piece_codec.merged(p, ties) for p in odd]
    monkeypatch.setattr(piece_codec, "FEW", -1)
    assert listed == [piece_codec.merged(p, codec.scores) for p in parts]
    assert tied == [piece_codec.merged(p, ties) for p in odd]
    texts = ["the house, the house", "", "x" * 90]
    assert [(x.tolist(), y) for x, y in codec.coded(texts)] == codec.encode(texts)
    assert all(isinstance(x, bytes) for x in codec.kept.values())
