"""Exact Jaccard join of word n-gram sets by universe partition and the pigeonhole principle.

Sets whose similarity reaches 0.8 differ in at most H tokens, H a quarter of the smaller size. The hashed universe is
divided into segments, more than H of them in a size band, so some segment holds the same tokens in both sets. Each set
therefore indexes its segments' subsets by band; in bands of small sets, where segments would hold too few tokens to tell
sets apart, it indexes half as many, larger segments with their one-deletion neighbourhoods, whichever costs less. A set
belongs to its own band and, where the smaller set of a pair may lie there, to the one below.

Empty segments tell nothing, and some subsets are held by many sets (a common line). Both can be left out by a set that has
H + 1 other segments, and a pair is found if one of its two sets has. For pairs of sets that both have not, empty segments are
indexed too, and sets full of common subsets take the finest partition, each token a segment of its own: of these a set indexes
the rarest, as many as the pigeonhole asks for with partners of a size class (a ratio of 1.05), so that tokens of a passage
that many sets share are indexed only by sets that it alone could link.

Candidates are not all pairs of those that share a subset: a subset links its sets to the least of them, within each task
first. Verified links make components. Where a common subset's sets are still in several components, rounds follow in which
each of them is compared with a set that stands in the middle of the subset's, another one in each round, until that joins
hardly any. Only then are pairs across the components left compared too: of a key that few sets share as rows, of which none
lie within the key's largest component; of one that many share by bitmaps in blocks of sets, two of them in a task, which tells
those pairs alone that differ in few enough bits. So unlinked sets that share most of their tokens, as form letters do, cost
time with their pairs, but rows only where they just miss a link. Verification compares the whole sets.

Sets are told apart by 128-bit hashes of their shingles, shingles by 64-bit hashes of their words.

Defined results: a null or blank text has the empty set and is linked with nothing; a text of fewer words than n is one
shingle; rows with the same id are rows of their own; a row without id is linked through rows that have its very set;
an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, giving_back, saved, text_or_empty
from .components import components
from .hashing import Powers, mix

RATIO = 1.25
#: Sets that share a subset beyond which it counts as common.
COMMON = 8
#: Subsets that it costs as much to index as one of a single token, which many sets share by chance.
LONE = 4
#: Rounds in which sets of common subsets are compared with one other each, at most, and the share of them that must be
#: linked for another round; what is still apart is compared across.
ROUNDS, WORTH = 8, 0.02
#: Bits of a subset's key beside the number of its part; keys that agree by chance only give a candidate more.
KEY_BITS = 40
#: Subsets of documents that a task gathers before it sends them, and ranges of keys, one after the other, of what meets.
GATHERED, RANGES = 1 << 19, 8
#: Bytes up to which a table, whose rows have been counted, is broadcast to join it; beyond that both sides are exchanged.
LIGHT = 16 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _ODD) | np.uint64(1)


def shingle_set(text: str | None, powers: Powers, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; bytes.lower knows ASCII letters only."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _BLANK[data]
    turns = np.flatnonzero(gap[1:] != gap[:-1])  # starts and ends of words in turn
    if not len(turns):
        return np.zeros(0, np.uint64)
    h = powers.ranges(powers.sums(data, 0), turns[::2], turns[1::2], 0)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _STEPS[i]
    out = mix(out)
    out.sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or 10 * min(len(a), len(b)) < 8 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


# Bands and their segments


@cache
def edges_of_bands() -> tuple[int, ...]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return tuple(out)


@cache
def scheme(band: int) -> tuple[int, int, bool]:
    """(H, segments, whether with one-deletion neighbourhoods) of a band, by cost: subsets indexed for a set, allowing for
    as many empty segments as chance (four deviations) leaves in the smallest set."""
    lo, hi = edges_of_bands()[band : band + 2]
    h = (hi - 1) // 4
    if h == 0:
        return 0, 1, False
    large = 1 if h == 1 else (h + 2) // 2 + 1
    m = h + 2
    while m <= 64 * lo:
        empty = math.exp(-lo / m)
        if m * (1 - empty) - 4 * math.sqrt(m * empty * (1 - empty)) >= h + 1:
            break
        m += max(1, m // 100)
    if m > 64 * lo or _cost(lo, large) + lo + LONE * 2 * _lone(lo, large, 2) < _cost(lo, m):
        return h, large, True
    return h, m, False


def _lone(size: int, m: int, tokens: int) -> float:
    """Segments of so many tokens among m, by chance."""
    load = size / m
    return m * math.exp(-load) * load**tokens / math.factorial(tokens)


def _cost(size: int, m: int) -> float:
    """Subsets that a set indexes in m segments, and what those of one token bring along."""
    return m * (1 - math.exp(-size / m)) + LONE * _lone(size, m, 1)


def bands_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(edges_of_bands()), sizes, side="right") - 1


def subsets(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the indexed subsets, the index of their set, and each set's slack: how many of its segments it could do
    without. A set of negative slack indexes its empty segments too."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    used = np.flatnonzero(sizes)
    slack = np.full(len(sets), 1 << 30, np.int64)
    own = bands_of(np.maximum(sizes, 1))
    start = np.array(edges_of_bands())
    keys, owners = [], []
    for below in (0, 1):
        part = used if not below else used[(own[used] > 0) & (-(-8 * sizes[used] // 10) < start[own[used]])]
        if not len(part):
            continue
        bands = own[part] - below
        h, m, near = (np.array(x) for x in zip(*map(scheme, bands.tolist()), strict=True))
        n = sizes[part]
        tokens = np.concatenate([sets[i] for i in part])
        at = np.repeat(np.arange(len(part)), n)  # the set of each token
        hashed = mix(tokens + _ODD * (bands[at] + 1).astype(np.uint64))
        base = np.concatenate([[0], np.cumsum(m)])
        seg = base[at] + (hashed % m[at].astype(np.uint64)).astype(np.int64)
        value = mix(hashed + _ODD)
        total = _sums(seg, value, int(base[-1]))
        count = np.bincount(seg, minlength=int(base[-1]))
        of = np.repeat(np.arange(len(part)), m)  # the set of each segment
        place = np.arange(int(base[-1]), dtype=np.uint64) - base[of].astype(np.uint64)
        salt = mix(place * _ODD + (bands[of] + 1).astype(np.uint64))
        worth = np.where(near[of], np.minimum(count, 2), np.minimum(count, 1))
        have = np.bincount(of, worth, len(part)).astype(np.int64)
        spare = have - (h + 1)
        slack[part] = np.minimum(slack[part], spare)
        needy = spare < 0
        take = (count > 0) | needy[of]
        keys.append(mix(total[take] + salt[take]))
        owners.append(part[of[take]])
        d = near[at] & ((count[seg] > 1) | needy[at])
        keys.append(mix(total[seg[d]] - value[d] + salt[seg[d]]))
        owners.append(part[at[d]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), slack
    return np.concatenate(keys), np.concatenate(owners), slack


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums modulo 2 ** 64 by index; halves of 32 bits stay exact in doubles."""
    low = np.bincount(index, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), size).astype(np.uint64)
    high = np.bincount(index, (values >> np.uint64(32)).astype(np.float64), size).astype(np.uint64)
    return low + (high << np.uint64(32))


def _set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _numbered(ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 16-byte ids in order, as rows of bytes, and the number of each given one among them."""
    words = np.frombuffer(ids, ">u8").reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return np.frombuffer(ids, np.uint8).reshape(-1, 16)[order[new]], number


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, all of one width, as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows))])


# The join

BINS = 256


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's tokens in 256 ranges, to 255. The distance of two sets' counts is at most what they differ in."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def _stars(keys: np.ndarray, sids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, sid) grouped by key: keys and least sids, then (key, least, other) of the groups' other members."""
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
    keys, sids = keys[new], sids[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = sids[first][np.cumsum(first) - 1] if len(keys) else sids
    return keys[first], sids[first], keys[~first], least[~first], sids[~first]


def _batch(fields: dict[str, pa.DataType], n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(c, None) if c in columns else pa.nulls(n, t) for c, t in fields.items()], names=list(fields))


def shared_subsets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """In one pass over the texts, two kinds of rows: (key, a, b), sets a and b share the subset `key` and a is the least
    that has it, in all tasks or in one; and for each document (id, n_shingles, sid, slack, sketch), sid null if it has none.

    A task gathers about GATHERED subsets at a time and sends each of them once, with its least set, as packed bytes for each
    part of the keys: KEY_BITS of the key, in order, and a number in the list of the sets sent along. Its other sets are linked
    to that one on the spot, and these rows are spread. So what meets in one place for a subset is at most an entry for each
    time that a task sends. There the entries stay packed but for one range of keys at a time."""
    spark = docs.sparkSession
    parts = min(1 << 15, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[id_col].dataType.simpleString()
    i64, raw = pa.int64(), pa.binary()
    light = {"id": None, "n_shingles": i64, "sid": raw, "slack": i64, "sketch": raw}
    sent = {"part": i64, "keys": raw, "owners": raw, "sids": raw, "key": i64, "a": raw, "b": raw}

    def linked_rows(fields: dict, ids: np.ndarray, key: np.ndarray, least: np.ndarray, other: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(key), 16_384):
            j = slice(i, i + 16_384)
            spread = {"part": pa.array(key[j] ^ other[j])} if "part" in fields else {}
            yield _batch(fields, len(key[j]), key=pa.array(key[j]), a=_binary(ids[least[j]]), b=_binary(ids[other[j]]), **spread)

    @giving_back
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, keys, owners, ids, fields, held = Powers(), [], [], [], None, 0
        for b in batches:
            fields = sent | light | {"id": b.column(0).type}
            sets = [shingle_set(t, powers, n) for t in b.column(1).to_pylist()]
            k, owner, slack = subsets(sets)
            own = [_set_id(s) if len(s) else None for s in sets]
            keys.append(k)
            owners.append(owner + len(ids))
            ids += [x or bytes(16) for x in own]
            part = np.array([int.from_bytes(x[:7], "little") if x else i for i, x in enumerate(own)], np.int64)
            yield _batch(fields, len(sets), part=pa.array(part), id=b.column(0), n_shingles=pa.array(map(len, sets), i64), sid=pa.array(own, raw), slack=pa.array(slack), sketch=pa.array([sketch(s) if len(s) else None for s in sets], raw))
            held += len(k)
            if held >= GATHERED:
                yield from packed_rows(fields, keys, owners, ids)
                keys, owners, ids, held = [], [], [], 0
        if held:
            yield from packed_rows(fields, keys, owners, ids)

    def packed_rows(fields: dict, keys: list[np.ndarray], owners: list[np.ndarray], ids: list[bytes]) -> Iterator[pa.RecordBatch]:
        distinct, number = _numbered(b"".join(ids))
        key = np.concatenate(keys)
        part = (key & np.uint64(0xFFFF)).astype(np.int64) % parts
        k, lo, *others = _stars(part << KEY_BITS | (key >> np.uint64(64 - KEY_BITS)).astype(np.int64), number[np.concatenate(owners)])
        yield from linked_rows(fields, distinct, *others)
        at = np.searchsorted(k, np.arange(parts + 1) << KEY_BITS)
        for p in range(parts):
            a, z = at[p], at[p + 1]
            if a < z:
                held, place = np.unique(lo[a:z], return_inverse=True)
                packed = np.ascontiguousarray(k[a:z].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
                yield _batch(fields, 1, part=pa.array([p], i64), keys=pa.array([packed.tobytes()], raw), owners=pa.array([place.astype("<u2" if len(held) < 1 << 16 else "<u4").tobytes()], raw), sids=pa.array([distinct[held].tobytes()], raw))

    @giving_back
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, ids, fields, before = [], [], None, 0
        for b in batches:
            fields = {"key": i64, "a": raw, "b": raw} | light | {"id": b.schema.field("id").type}
            packed = b.column("keys").is_valid()
            yield b.filter(pc.invert(packed)).select(list(fields))
            rows = b.filter(packed).select(["part", "keys", "owners", "sids"])
            for part, k, number, held in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                k = np.frombuffer(k, np.uint8).reshape(-1, KEY_BITS // 8)
                cuts = np.searchsorted(k[:, -1], np.arange(RANGES + 1) * (256 // RANGES))  # by the highest byte
                entries.append((part, k, np.frombuffer(number, "<u2" if len(number) == 2 * len(k) else "<u4"), before, cuts))
                ids.append(held)
                before += len(held) // 16
        if entries:
            distinct, number = _numbered(b"".join(ids))
            for r in range(RANGES):
                keys, owners = [], []
                for part, k, places, start, cuts in entries:
                    a, z = cuts[r : r + 2]
                    wide = np.zeros((z - a, 8), np.uint8)
                    wide[:, : KEY_BITS // 8] = k[a:z]
                    keys.append(wide.view("<i8").ravel() | part << KEY_BITS)
                    owners.append(number[places[a:z].astype(np.int64) + start])
                yield from linked_rows(fields, distinct, *_stars(np.concatenate(keys), np.concatenate(owners))[2:])

    own = f"id {kind}, n_shingles bigint, sid binary, slack bigint, sketch binary"
    rows = docs.select(id_col, text_col).mapInArrow(emit, f"part bigint, keys binary, owners binary, sids binary, key bigint, a binary, b binary, {own}")
    return rows.repartition(parts, "part").mapInArrow(meet, f"key bigint, a binary, b binary, {own}")


def sieved(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, of which Spark may make a Bloom filter (of a fixed size) for the other side of a join on `key`, before that is
    exchanged. The comparison is true of every key but null; it is what lets Spark consider that for a written table."""
    least = {"bigint": F.lit(-(2**63)), "binary": F.lit(b"")}.get(dict(rows.dtypes)[key])
    return rows if least is None else rows.where(F.col(key) >= least)


@contextmanager
def bloom_filters(df: DataFrame) -> Iterator[None]:
    """Lets Spark consider runtime Bloom filters for tables of any size, not from 10 GB only."""
    conf, name = df.sparkSession.conf, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = conf.get(name)
    conf.set(name, "0")
    try:
        yield
    finally:
        conf.set(name, before)


def near_enough(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of sets that sizes and sketches allow to be linked, with their representatives' ids. Sketches
    of linked sets differ by at most a ninth of what both hold."""
    pairs = saved(pairs)
    sids = saved(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct())
    with bloom_filters(pairs):
        some = saved(sieved(sids, "sid").join(reps, "sid"))
    of = lambda s: some.select(F.col("sid").alias(s), F.col("rep").alias(f"rep_{s}"), F.col("n_shingles").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(_SIZED).select("a", "b", "rep_a", "rep_b", "n_a", "n_b", "sketch_a", "sketch_b")

    @giving_back
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in ("sketch_a", "sketch_b"))
            gap = np.abs(x - y).sum(axis=1, dtype=np.int64)
            mask = pa.array(9 * gap <= b.column("n_a").to_numpy() + b.column("n_b").to_numpy())
            yield b.select(["a", "b", "rep_a", "rep_b"]).filter(mask)

    kind = reps.schema["rep"].dataType.simpleString()
    return saved(near.mapInArrow(close, f"a binary, b binary, rep_a {kind}, rep_b {kind}"))


_SIZED = "n_a * 10 >= n_b * 8 and n_b * 10 >= n_a * 8"


def with_texts(rows: DataFrame, docs: DataFrame, key: str, id_col: str, text_col: str, into: str = "text") -> DataFrame:
    """`rows` with the whole texts of the documents whose ids stand in `key`."""
    return sieved(rows, key).join(docs.select(F.col(id_col).alias(key), text_or_empty(text_col).alias(into)), key)


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """Those of the pairs (a, b) of sets that are linked; their representatives' whole texts come together by two joins."""
    rows = with_texts(near_enough(pairs, reps), docs, "rep_b", id_col, text_col, "text_b")
    rows = with_texts(rows, docs, "rep_a", id_col, text_col, "text_a").select("a", "b", "text_a", "text_b")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, last, first = Powers(), None, None
        for batch in batches:
            found = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != ta:
                    last, first = ta, shingle_set(ta, powers, n)
                second = shingle_set(tb, powers, n)
                # A representative's id may stand on rows of other texts.
                found.append(linked(first, second) and _set_id(first) == a and _set_id(second) == b)
            mask = pa.array(found, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    with bloom_filters(docs):
        return saved(rows.mapInArrow(run, "a binary, b binary"))


def token_sets(sids: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(sid, tokens) of the sets named in `sids`, the tokens as packed 64-bit hashes in order. A set comes more than once if its
    representative's id stands on several rows of its text."""
    named = saved(sids.join(reps.select("sid", "rep"), "sid"))
    rows = with_texts(named, docs, "rep", id_col, text_col).select("sid", "text")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in batches:
            sets = [shingle_set(t, powers, n) for t in b.column(1).to_pylist()]
            own = pa.array([_set_id(s) == sid for s, sid in zip(sets, b.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(own), pa.array([s.tobytes() for s in sets], pa.binary()).filter(own)], names=["sid", "tokens"])

    with bloom_filters(docs):
        return saved(rows.mapInArrow(run, "sid binary, tokens binary"))


def verified_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are linked, from the table of `token_sets`."""
    of = lambda s: sets.select(F.col("sid").alias(s), F.col("tokens").alias(f"tokens_{s}"))
    rows = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "tokens_a", "tokens_b")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return saved(rows.mapInArrow(run, "a binary, b binary"))


def most_shared(shared: DataFrame) -> DataFrame:
    """Of rows (a, b) for each subset they share: each b with the a it shares most with."""
    by_pair = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
    return by_pair.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the least id that links lead to)."""
    arrow_rows(docs.sparkSession)
    both = saved(shared_subsets(docs, id_col, text_col, n))
    light = both.where("n_shingles is not null")
    shared = both.where("key is not null").select("key", "a", "b")
    firsts = (F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("slack").alias("slack"), F.first("sketch").alias("sketch"))
    reps = saved(light.where("sid is not null").groupBy("sid").agg(*firsts))

    links = verified(most_shared(shared), reps, docs, id_col, text_col, n)
    roots = saved(components(links))

    # Common subsets: those of sets that can't do without them; pairs of which one can are found by the others.
    common = saved(shared.groupBy("key").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") > COMMON).select("key"))
    often = shared.join(sized(common, 8), "key")
    members = often.select("key", F.col("a").alias("sid")).unionByName(often.select("key", F.col("b").alias("sid"))).distinct()
    members = apart(saved(rooted(members, roots)))
    burden = members.groupBy("sid").agg(F.count(F.lit(1)).alias("commons"))
    needy = saved(burden.join(reps.select("sid", "slack", "n_shingles"), "sid").where("slack < 2 * commons").select("sid", "slack", "n_shingles"))
    sets = token_sets(needy.select("sid"), reps, docs, id_col, text_col, n)
    crowded, roots = settled(saved(members.join(sized(needy, 32), "sid")), roots, sets)

    pairs = rare_pairs(shared.join(sized(common, 8), "key", "left_anti"), roots)
    more = verified(pairs, reps, docs, id_col, text_col, n)
    roots = merged(roots, more.unionByName(crowd_links(finest(crowded, sets), sets)))

    known = roots.join(reps.select(F.col("sid").alias("node"), "rep"), "node")
    least = saved(known.groupBy("root").agg(F.min("rep").alias("component_id")))
    near = saved(roots.join(least, "root").select(F.col("node").alias("sid"), "component_id"))
    same = reps.where("rows > 1").join(near, "sid", "left_anti").select("sid", F.col("rep").alias("component_id"))
    of = saved(near.unionByName(same))
    out = light.join(of, "sid", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def sized(df: DataFrame, width: int) -> DataFrame:
    """A written table for the smaller side of a join: broadcast if its rows of so many bytes are few enough."""
    return F.broadcast(df) if df.count() * width <= LIGHT else df


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`members` with the roots of their sets."""
    return members.join(sized(roots.withColumnRenamed("node", "sid"), 32), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def apart(members: DataFrame) -> DataFrame:
    """The rows of the subsets whose sets have several roots; `members` is a written table."""
    keys = saved(members.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key"))
    return saved(members.join(sized(keys, 8), "key"))


def rare_pairs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of sets in different components that share a subset which COMMON + 1 sets have at most."""
    every = F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = saved(shared.groupBy("key").agg(every.alias("m")).select(F.inline(pairs)).distinct())
    ends = rooted(rooted(both.withColumnRenamed("a", "sid"), roots).select(F.col("sid").alias("a"), F.col("root").alias("root_a"), F.col("b").alias("sid")), roots)
    return ends.where("root_a <> root").select("a", F.col("sid").alias("b"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` after further links: the components of the old roots."""
    ends = rooted(rooted(links.withColumnRenamed("a", "sid"), roots).select(F.col("root").alias("a"), F.col("b").alias("sid")), roots)
    more = saved(components(ends.select("a", F.col("root").alias("b"))))
    old = roots.join(sized(more.select(F.col("node").alias("root"), F.col("root").alias("top")), 32), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return saved(old.unionByName(more.join(roots.select("node"), "node", "left_anti")))


def settled(crowded: DataFrame, roots: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rounds on the rows (key, sid, root, slack, n_shingles) of common subsets. In each, a subset names the set that most of whose subsets
    are common ones, in later rounds with a random factor: among near copies that is the one with the fewest changes. Each set
    is compared with the one, of those its subsets name, that it shares most with. Gives the rows of the subsets that are
    still apart, with roots, and all roots."""
    for turn in range(ROUNDS):
        central = crowded.groupBy("sid").agg((F.count(F.lit(1)) / F.first("n_shingles")).alias("central"))
        chance = F.pmod(F.xxhash64("sid", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20) if turn else F.lit(1.0)
        first = crowded.join(central, "sid").groupBy("key").agg(F.max_by(F.struct("sid", "root", "n_shingles"), F.struct(F.col("central") * chance, "sid")).alias("first"))
        shared = crowded.join(first, "key").select(F.col("first.sid").alias("a"), F.col("sid").alias("b"), F.col("first.root").alias("root_a"), F.col("root").alias("root_b"), F.col("first.n_shingles").alias("n_a"), F.col("n_shingles").alias("n_b"))
        pairs = saved(most_shared(shared.where(f"root_a <> root_b and {_SIZED}").select("a", "b")))
        links = verified_sets(pairs, sets)
        found = links.count()
        if found:
            roots = merged(roots, links)
            crowded = apart(saved(rooted(crowded.drop("root"), roots)))
        if found <= WORTH * pairs.count():
            break
    return crowded, roots


KEYS = ("token", "low", "high")
#: Sets of a key up to which their pairs are rows, and sets of a block beyond.
FEW, BLOCK = 16, 4096


def crowd_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components among the sets that share a key of `finest`. Of a key of up to FEW sets the pairs are
    rows. The sets of larger ones are compared by bitmaps, block by block, and a task tells those pairs alone whose bitmaps
    leave a link possible."""
    by_root = rows.groupBy(*KEYS, "root").agg(F.count(F.lit(1)).alias("sets"))
    of_key = by_root.groupBy(*KEYS).agg(F.max_by("root", F.struct("sets", "root")).alias("most"), F.sum("sets").alias("held"), F.count(F.lit(1)).alias("roots"))
    rows = saved(rows.join(of_key.where("roots > 1").drop("roots"), list(KEYS)))
    pairs = crossing(rows.where(F.col("held") <= FEW))  # distinct
    crowds = rows.where(F.col("held") > FEW)
    if not crowds.isEmpty():
        pairs = pairs.unionByName(crowded_pairs(crowds, sets)).distinct()
    return verified_sets(saved(pairs), sets)


def crossing(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of sets of like size in different components that share a key (token, low, high) of `finest`. Of
    the largest component of a key none meet each other. `at` is the token's place in a set: as a pair's first common one, it
    leaves no more common tokens than stand behind it in either set."""
    side = lambda s: rows.select(*KEYS, *[F.col(c).alias(f"{d}_{s}") for c, d in (("root", "root"), ("n_shingles", "n"), ("at", "at"), ("kind", "kind"))], F.col("sid").alias(s), (F.col("root") == F.col("most")).alias(f"most_{s}"))
    met = side("a").where("not most_a").join(side("b"), list(KEYS))
    met = met.where(f"root_a <> root_b and (most_b or a < b) and (kind_a <> kind_b or low = high) and {_SIZED} and 9 * (least(n_a - at_a, n_b - at_b) + 1) >= 4 * (n_a + n_b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each of at least eight times as many places as tokens, turned over by every token of that place. The bits in
    which two sets' maps differ are at most the tokens in which the sets do, and hardly fewer. Folded in half, by exclusive or, a
    map is that of half as many places."""
    places = max(256, 1 << (8 * len(s) - 1).bit_length())
    counts = np.bincount((mix(s + _ODD) & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _words(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to `width` bytes."""
    out = np.empty((len(maps), width // 8), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        while len(x) > width // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def possible_links(a: tuple[list[bytes], np.ndarray], b: tuple[list[bytes], np.ndarray]) -> np.ndarray:
    """(len(a), len(b)) of sets' maps and sizes: whether sizes and maps allow a link. Linked sets differ by a ninth of what both hold
    at most."""
    (maps_a, n), (maps_b, m) = a, b
    out = np.zeros((len(n), len(m)), bool)
    order, other = np.argsort(n, kind="stable"), np.argsort(m, kind="stable")
    for i in range(0, len(n), 64):  # sets of like size together
        rows = order[i : i + 64]
        near = other[np.searchsorted(m[other], -(-n[rows[0]] * 8 // 10), "left") : np.searchsorted(m[other], n[rows[-1]] * 10 // 8, "right")]
        for j in range(0, len(near), 1024):
            cols = near[j : j + 1024]
            width = min(len(maps_a[rows[0]]), len(maps_b[cols[0]]))
            gap = np.bitwise_count(_words([maps_a[r] for r in rows], width)[:, None, :] ^ _words([maps_b[c] for c in cols], width)[None, :, :]).sum(axis=2, dtype=np.int64)
            both = n[rows][:, None] + m[cols][None, :]
            sized_ = (10 * n[rows][:, None] >= 8 * m[cols][None, :]) & (10 * m[cols][None, :] >= 8 * n[rows][:, None])
            out[np.ix_(rows, cols)] = sized_ & (9 * gap <= both)
    return out


def crowded_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components of the rows of large keys that sizes and bitmaps allow to be linked. The sets of a token
    are dealt by a hash into blocks of about BLOCK, and each goes to all tasks that compare its block with another."""

    @giving_back
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bitmap(np.frombuffer(t, np.uint64)) for t in b.column(1).to_pylist()], pa.binary())], names=["sid", "map"])

    held = rows.select("token", "sid", "root", "n_shingles", F.ceil(F.col("sets") / BLOCK).cast("int").alias("blocks")).distinct()
    mapped = sets.dropDuplicates(["sid"]).select("sid", "tokens").mapInArrow(maps, "sid binary, map binary")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.least(own, q).alias("i"), F.greatest(own, q).alias("j"), (own > q).alias("second")))
    dealt = held.join(mapped, "sid").select("token", "sid", "root", "n_shingles", "map", F.inline(met))
    by = ["token", "i", "j"]

    def compare(rows: list[tuple], alone: bool) -> list[tuple[bytes, bytes]]:
        a = [r for r in rows if not r[4]]
        b = a if alone else [r for r in rows if r[4]]
        if not a or not b:
            return []
        number = {root: i for i, root in enumerate({r[1] for r in rows})}
        of = lambda side: ([r[3] for r in side], np.array([r[2] for r in side], np.int64))
        apart_ = np.array([number[r[1]] for r in a])[:, None] != np.array([number[r[1]] for r in b])[None, :]
        found = np.argwhere(possible_links(of(a), of(b)) & apart_)
        return [(min(a[x][0], b[y][0]), max(a[x][0], b[y][0])) for x, y in found.tolist() if not alone or x < y]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        given = lambda pairs: pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)] if pairs else [pa.array([], pa.binary())] * 2, names=["a", "b"])
        for batch in batches:
            pairs: list[tuple[bytes, bytes]] = []
            for *now, sid, root, n, own_map, second in zip(*(batch.column(c).to_pylist() for c in (*by, "sid", "root", "n_shingles", "map", "second")), strict=True):
                if now != key:
                    pairs += compare(rows, key is not None and key[1] == key[2])
                    key, rows = now, []
                rows.append((sid, root, n, own_map, second))
            yield given(pairs)
        yield given(compare(rows, key is not None and key[1] == key[2]))

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary")


def finest(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (token, low, high), with the number of sets of the token, of the sets that can't do without common subsets and have some still apart: the rarest tokens of
    each, for partners of each size class. Linked sets of sizes a and b share four ninths of a + b tokens at least, so the
    first of these in an order of all tokens stands that far before the end of both. Tokens of one component alone come first
    and pair none."""
    needy = crowded.groupBy("sid").agg(F.first("root").alias("root"), F.first("n_shingles").alias("n_shingles"), F.first("slack").alias("slack"), F.count(F.lit(1)).alias("commons"))
    needy = saved(needy.where("slack < 2 * commons").select("sid", "root", "n_shingles"))

    @giving_back
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(tokens, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array([sid] * len(s), pa.binary())], names=["token", "sid"])

    held = saved(sets.join(sized(needy.select("sid"), 16), "sid").dropDuplicates(["sid"]).mapInArrow(spread, "token bigint, sid binary").join(sized(needy, 40), "sid"))
    often = saved(held.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("token", "sets"))
    both = held.join(often, "token")
    alone = F.col("n_shingles") - F.count(F.lit(1)).over(W.partitionBy("sid"))
    place = F.row_number().over(W.partitionBy("sid").orderBy("sets", "token"))
    size = lambda c: F.floor(F.log(c) / F.lit(math.log(STEP))).cast("int")
    a, least = F.col("n_shingles"), F.ceil(F.col("n_shingles") * 8 / 10)
    most = F.least(F.floor(a * 10 / 8), F.floor((a - F.col("at") + 1) * 9 / 4) - a)
    rows = both.withColumn("at", alone + place).withColumns({"kind": size(a), "least": least, "most": most}).where("most >= least")
    rows = rows.withColumn("partner", F.explode(F.sequence(size(F.col("least")), size(F.col("most")))))
    return saved(rows.select("token", F.least("kind", "partner").alias("low"), F.greatest("kind", "partner").alias("high"), "sid", "root", "n_shingles", "at", "kind", "sets"))


#: Ratio of the size classes of partners.
STEP = 1.05


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """`docs` with all its columns, of each component the document with the least id."""
    own = f"gone_{uuid.uuid4().hex}"
    gone = near_duplicates(docs, id_col, text_col, n).where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(own))
    return docs.join(saved(gone.distinct()), F.col(id_col) == F.col(own), "left_anti")
