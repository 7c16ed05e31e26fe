"""The prefix trie of conversations, from their sorted order and its common prefixes.

A turn becomes a token of `TOKEN` characters (128-bit hash of role and text, bytes of the text), a conversation the string of its tokens. Equal
conversations are counted once. The distinct ones are sorted over range partitions, the blocks; a position's value is the
length, in turns, of the prefix it shares with the one before. Nodes with several children are the intervals of the Cartesian
tree over these values: a position's interval runs from the nearest smaller value on its left to that on its right, and
positions with one interval are one node. The nearest smaller values are found block by block, in parallel; those that a
block does not hold are looked up in the nearest block whose least value is smaller, among the few positions of that block
that no later (or earlier) one undercuts. What a node says of its members is a difference of running sums, or a least id put
together from parts of blocks. Depths between an interval's value and the next smaller one around it are nodes with one
child and the same members; depths past all shared prefixes are those of one conversation alone.

The driver holds a few figures for each block, nothing for a conversation. A conversation's tokens (not its texts) are one row.
A hot group of equal conversations is counted within tasks first, and its ids are hashed in order, as a stream of chunks.

Defined results: turns are in the order of `turn`, null first, and of their tokens where it ties; null role or text is empty;
rows without conv_id are left out; an empty table gives no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

HASH, TOKEN = 32, 40
#: Distinct conversations of a block, which one task holds as a few numbers each.
BLOCK_ROWS = 250_000
#: Characters of the ids in a chunk that is hashed.
CHUNK = 1 << 16
NOBODY = np.iinfo(np.int64).max


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, tokens) of every conversation, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text))), F.lpad(F.hex(F.octet_length(text)), TOKEN - HASH, "0"))
    own = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), told.alias("token")).alias("t"))
    return own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t.token).alias("tokens"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, tokens): the first h turns of the conversation whose id is the next lower multiple of 5, then the own turns after
    the first h; h follows from the id."""
    first = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("tokens", 1, 8).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    both = own.withColumn("base", F.expr("conv_id - conv_id % 5")).join(first, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    return both.select("conv_id", F.concat(head, F.slice("tokens", h + 1, F.greatest(F.size("tokens"), F.lit(1)))).alias("tokens"))


def common(a: str, b: str) -> int:
    """Tokens that two conversations share from the start."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TOKEN : mid * TOKEN] == b[low * TOKEN : mid * TOKEN]:
            low = mid
        else:
            high = mid - 1
    return low


def bytes_before(path: str) -> np.ndarray:
    """Bytes of the texts of the first 0, 1, ... turns."""
    digits = np.frombuffer(path.encode(), np.uint8).reshape(-1, TOKEN)[:, HASH:].astype(np.int64)
    sizes = np.where(digits > 57, digits - 55, digits - 48) @ (16 ** np.arange(TOKEN - HASH - 1, -1, -1, dtype=np.int64))
    return np.concatenate([[0], np.cumsum(sizes)])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted block's conversations with the prefix each shares with the one before; the first has none yet."""
    block, at, before = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        rows = batch.to_pydict()
        value, shared, sums = [], [], []
        for path in rows["path"]:
            sums.append(bytes_before(path))
            value.append(None if before is None else common(before, path))
            shared.append(None if before is None else int(sums[-1][value[-1]]))
            before = path
        m = len(sums)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([block] * m, pa.int32()), "at": pa.array(range(at, at + m), pa.int64()), "id": batch.column("id"), "n": batch.column("n"), "depth": pa.array([len(s) - 1 for s in sums], pa.int32()),
            "value": pa.array(value, pa.int32()), "shared": pa.array(shared, pa.int64()), "bytes": pa.array(sums, pa.list_(pa.int64())), "path": batch.column("path"),
        })
        at += m


def _edges(found: DataFrame) -> pd.DataFrame:
    """A row for each block that holds any: rows, least value, and what its first conversation shares with the block before."""

    def shared(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            value = [-1 if x is None else common(x, y) for x, y in zip(b["before"], b["first"], strict=True)]
            own = [int(bytes_before(y)[max(v, 0)]) for v, y in zip(value, b["first"], strict=True)]
            yield b[["block", "n", "least"]].assign(value=value, shared=own)

    ends = found.groupBy("block").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))
    paired = ends.withColumn("before", F.lag("last").over(W.orderBy("block"))).drop("last")  # a row a block
    out = paired.mapInPandas(shared, "block int, n long, least int, value int, shared long").toPandas().sort_values("block", ignore_index=True)
    out["least"] = out[["least", "value"]].min(axis=1).astype(int)
    return out


def _nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nearest smaller value on the left (-1: none) and on the right (length: none)."""
    m, stack = len(values), []
    left, right = np.full(m, -1), np.full(m, m)
    listed = values.tolist()
    for i, v in enumerate(listed):
        while stack and listed[stack[-1]] > v:
            right[stack.pop()] = i
        # Of equal values the earlier one stays: its left is the left of both.
        if stack and listed[stack[-1]] == v:
            left[i] = left[stack[-1]]
        elif stack:
            left[i] = stack[-1]
        stack.append(i)
    return left, right


def _least_between(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of x[start:end], for many ranges, by minima over powers of two."""
    table = [x]
    while 2 << (len(table) - 1) <= len(x):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    level = np.frexp(end - start)[1] - 1
    out = np.empty(len(start), np.int64)
    for k in np.unique(level):
        pick = level == k
        out[pick] = np.minimum(table[k][start[pick]], table[k][end[pick] - (1 << int(k))])
    return out


_BLOCK = (
    "block int, pos long, id long, n long, depth int, value int, following int, shared long, total long, members long, told long, fresh long, leaves long, "
    "left long, right long, low long, left_low long, right_low long, left_block int, right_block int, under_later boolean, under_earlier boolean, suffix_low long, prefix_low long"
)


def _block_rows(found: DataFrame, edges: pd.DataFrame) -> DataFrame:
    """Positions with running sums before them in their block, and their nearest smaller values: `left` and `right` with the
    least ids up to the block's end, or the block that holds them."""
    blocks, least, values, shared, start = edges["block"].to_numpy(), edges["least"].to_numpy(), edges["value"].to_numpy(), edges["shared"].to_numpy(), np.concatenate([[0], np.cumsum(edges["n"])])

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        b, m = int(np.searchsorted(blocks, rows["block"].iloc[0])), len(rows)
        value = rows["value"].fillna(-2).to_numpy(np.int64)
        own_shared = rows["shared"].fillna(0).to_numpy(np.int64)
        value[0], own_shared[0] = values[b], shared[b]
        following = np.append(value[1:], values[b + 1] if b + 1 < len(values) else -1)
        ids, n, depth, total = (rows[c].to_numpy(np.int64) for c in ("id", "n", "depth", "total"))
        before = lambda x: np.concatenate([[0], np.cumsum(x)[:-1]])
        left, right = _nearest_smaller(value)
        prefix, suffix = np.minimum.accumulate(ids), np.minimum.accumulate(ids[::-1])[::-1]
        inside, off = (left >= 0) & (right < m), int(start[b])
        low = np.full(m, NOBODY)
        if inside.any():
            low[inside] = _least_between(ids, left[inside], right[inside])
        # Blocks with a smaller least value, nearest first: only for values that this block does not settle.
        lefts = {v: next((int(blocks[k]) for k in range(b - 1, -1, -1) if least[k] < v), None) for v in np.unique(value[left < 0])}
        rights = {v: next((int(blocks[k]) for k in range(b + 1, len(blocks)) if least[k] < v), None) for v in np.unique(value[right == m])}
        maybe = lambda x, known: pd.Series(x, dtype="Int64").mask(~known)
        return pd.DataFrame({
            "block": rows["block"], "pos": off + np.arange(m), "id": ids, "n": n, "depth": depth, "value": value, "following": following, "shared": own_shared, "total": total,
            "members": before(n), "told": before(n * total), "fresh": before(total - own_shared), "leaves": before(depth > following),
            "left": maybe(off + left, left >= 0), "right": maybe(off + right, right < m), "low": maybe(low, inside),
            "left_low": maybe(suffix[np.maximum(left, 0)], left >= 0), "right_low": maybe(np.where(right > 0, prefix[np.maximum(right, 1) - 1], NOBODY), right < m),
            "left_block": pd.array([lefts[v] if x < 0 else None for v, x in zip(value, left, strict=True)], dtype="Int64"), "right_block": pd.array([rights[v] if x == m else None for v, x in zip(value, right, strict=True)], dtype="Int64"),
            "under_later": (right == m) & (np.append(np.minimum.accumulate(value[::-1])[::-1][1:], np.iinfo(np.int64).max) > value), "under_earlier": (left < 0) & (np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(value)[:-1]]) > value),
            "suffix_low": suffix, "prefix_low": np.concatenate([[NOBODY], prefix[:-1]]),
        })

    given = found.select("block", "at", "id", "n", "depth", "value", "shared", F.element_at("bytes", -1).alias("total"))
    return given.groupBy("block").applyInPandas(one, _BLOCK)


def _looked_up(asked: DataFrame, held: DataFrame, side: str) -> DataFrame:
    """(block, value, `side`, low) of values that a block does not settle: the nearest smaller position of another block."""

    def one(wants: pd.DataFrame, has: pd.DataFrame) -> pd.DataFrame:
        has = has.sort_values("value", ignore_index=True)
        k = np.searchsorted(has["value"].to_numpy(), wants["value"].to_numpy()) - 1  # values differ; the largest below is nearest
        return pd.DataFrame({"block": wants["block"], "value": wants["value"], side: has["pos"].to_numpy()[k], f"{side}_low": has["low"].to_numpy()[k]})

    return asked.groupBy("at_block").cogroup(held.groupBy("block")).applyInPandas(lambda w, h: one(w, h) if len(w) else pd.DataFrame({"block": [], "value": [], side: [], f"{side}_low": []}), f"block int, value int, {side} long, {side}_low long")


def _settled(rows: DataFrame, edges: pd.DataFrame, total: int) -> DataFrame:
    """(pos, value, left, right, low) of every position but the first: its interval and the least id in it."""
    spark, real = rows.sparkSession, F.col("value") >= 0
    own = rows.where(real).select("block", "pos", "value", "left", "right", "low", F.when(F.col("left").isNull(), 0).otherwise(1).alias("kind"))
    open_ = rows.where(real & (F.col("left").isNull() | F.col("right").isNull()))
    # The positions of a block that it does not settle on the left, by value, have one right; those on the right alone, one left.
    asked = saved(open_.select("block", "value", F.when(F.col("left").isNull(), 0).otherwise(1).alias("kind"), "left", "right", "left_low", "right_low", "left_block", "right_block").distinct())
    lefts = _looked_up(asked.where("left is null").select("block", "value", F.col("left_block").alias("at_block")).distinct(), rows.where("under_later").select("block", "value", "pos", F.col("suffix_low").alias("low")), "left")
    rights = _looked_up(asked.where("right_block is not null").select("block", "value", F.col("right_block").alias("at_block")).distinct(), rows.where("under_earlier").select("block", "value", "pos", F.col("prefix_low").alias("low")), "right")
    found = asked.join(lefts.withColumnsRenamed({"left": "l", "left_low": "ll"}), ["block", "value"], "left").join(rights.withColumnsRenamed({"right": "r", "right_low": "rl"}), ["block", "value"], "left")
    lows = spark.createDataFrame([(edges["low"].tolist(),)], "lows array<long>")  # a figure for each block
    place = lambda c: F.array_position(F.lit(edges["block"].tolist()), c).cast("int")
    first = place(F.when(F.col("left").isNull(), F.col("left_block")).otherwise(F.col("block")))
    last = F.when(F.col("right").isNotNull(), place(F.col("block"))).when(F.col("right_block").isNotNull(), place(F.col("right_block"))).otherwise(F.lit(len(edges) + 1))
    between = F.array_min(F.slice("lows", first + 1, F.greatest(last - first - 1, F.lit(0))))
    ends = F.least(F.coalesce("left_low", "ll"), F.coalesce("right_low", "rl", F.lit(NOBODY)), F.coalesce(between, F.lit(NOBODY)))
    told = found.crossJoin(F.broadcast(lows)).select("block", "value", "kind", F.coalesce("left", "l").alias("l"), F.coalesce("right", "r", F.lit(total)).alias("r"), ends.alias("least"))
    both = own.join(told, ["block", "value", "kind"], "left")
    inside = F.col("left").isNotNull() & F.col("right").isNotNull()
    return both.select("pos", "value", *[F.when(inside, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("left", "l"), ("right", "r"), ("low", "least"))])


def ends(paths: DataFrame) -> DataFrame:
    """(id, ends_sha256): of equal conversations the least id, and the hash of all ids in order."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, text = None, 0, []
        pack = lambda: pa.RecordBatch.from_pydict({"seq": [seq], "first": pa.array([first], pa.int64()), "text": [",".join(text)]})
        size = 0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != seq or size > CHUNK:
                    if seq is not None:
                        for o, v in zip(out, (seq, first, ",".join(text)), strict=True):
                            o.append(v)
                    seq, first, text, size = s, c, [], 0
                text.append(str(c))
                size += len(text[-1]) + 1
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2])], ["seq", "first", "text"])
        if seq is not None:
            yield pack()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, state = None, 0, None
        for batch in batches:
            ids, sums = [], []
            for s, f, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s == seq:
                    state.update(b"," + t.encode())
                    continue
                if seq is not None:
                    ids.append(first)
                    sums.append(state.hexdigest())
                seq, first, state = s, f, hashlib.sha256(t.encode())
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "ends": pa.array(sums, pa.string())})
        if seq is not None:
            yield pa.RecordBatch.from_pydict({"id": pa.array([first], pa.int64()), "ends": [state.hexdigest()]})

    rows = paths.select(F.md5("path").alias("seq"), "conv_id")
    cut = rows.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(chunks, "seq string, first long, text string")
    return cut.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "id long, ends string")


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, tokens): `rebuilt(turns(rows))`, or any other sequences of tokens."""
    spark = conversations.sparkSession
    paths = saved(conversations.select("conv_id", F.array_join("tokens", "").alias("path")))
    distinct = saved(paths.groupBy("path").agg(F.min("conv_id").alias("id"), F.count(F.lit(1)).alias("n")))
    count = distinct.count()
    if not count:
        return spark.createDataFrame([], _NODES)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // BLOCK_ROWS))
    found = saved(
        distinct.repartitionByRange(blocks, "path").sortWithinPartitions("path")
        .mapInArrow(_scan, "block int, at long, id long, n long, depth int, value int, shared long, bytes array<long>, path string")
    )
    edges = _edges(found)
    rows = saved(_block_rows(found, edges))
    # Sums up to a block's start, a row for each block.
    sums = ("members", "told", "fresh", "leaves")
    added = dict(zip(sums, ("n", F.col("n") * F.col("total"), F.col("total") - F.col("shared"), (F.col("depth") > F.col("following")).cast("long")), strict=True))
    all_ = rows.groupBy("block").agg(F.min("id").alias("low"), *[F.sum(v).alias(k) for k, v in added.items()]).toPandas().sort_values("block", ignore_index=True)
    edges["low"] = all_["low"]
    starts = all_[[*sums]].cumsum().shift(fill_value=0).astype("int64")
    offsets = F.broadcast(spark.createDataFrame([(int(b), *map(int, s)) for b, s in zip(all_["block"], starts.to_numpy(), strict=True)], "block int, " + ", ".join(f"{c}_0 long" for c in sums)))
    rows = rows.join(offsets, "block").withColumns({c: F.col(c) + F.col(f"{c}_0") for c in sums}).drop(*[f"{c}_0" for c in sums])
    whole = {c: int(v) for c, v in all_[[*sums]].sum().items()}

    positions = saved(_settled(rows, edges, count))
    intervals = positions.groupBy("left", "right").agg(F.min("value").alias("v"), F.count(F.lit(1)).alias("k"), F.min("low").alias("id"))
    at = lambda side: rows.select(F.col("pos").alias(side), F.col("value").alias(f"value_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in sums], *([F.col("shared"), F.col("depth")] if side == "left" else []))
    held = intervals.join(at("left"), "left").join(at("right"), "right", "left")
    less = lambda c: F.coalesce(F.col(f"{c}_right"), F.lit(whole[c])) - F.col(f"{c}_left")
    right_value = F.coalesce("value_right", F.lit(-1))
    inner = held.select(
        "left", "v", "id", F.greatest("value_left", right_value).alias("p"), (F.col("k") + 1 - (F.col("depth") == F.col("v")).cast("long")).alias("children"), less("members").alias("n_convs"), less("leaves").alias("n_leaves"),
        (less("told") - less("fresh") - F.col("shared")).alias("saved"), F.when(F.col("value_left") >= right_value, F.col("left")).otherwise(F.col("right")).alias("parent"),
    )
    alone = F.greatest("value", "following")
    tails = rows.where(F.col("depth") > alone).select(
        F.col("pos").alias("left"), F.col("depth").alias("v"), "id", alone.alias("p"), F.lit(0).cast("long").alias("children"), F.col("n").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("total")).alias("saved"), F.when(F.col("value") >= F.col("following"), F.col("pos")).otherwise(F.col("pos") + 1).alias("parent"),
    )
    nodes = inner.unionByName(tails)
    # What the node's first conversation adds: bytes before each depth, and the hash of those that end with it.
    places = spark.createDataFrame([(int(b), int(s)) for b, s in zip(edges["block"], np.concatenate([[0], np.cumsum(edges["n"])[:-1]]), strict=True)], "block int, first long")
    firsts = found.join(F.broadcast(places), "block").select((F.col("first") + F.col("at")).alias("left"), F.col("id").alias("own"), F.col("depth").alias("whole"), "bytes")
    firsts = firsts.join(ends(paths).withColumnRenamed("id", "own"), "own").drop("own")
    parents = positions.select(F.col("pos").alias("parent"), F.col("low").alias("parent_id"))
    full = nodes.join(firsts, "left").join(parents, "parent", "left")
    deep = full.select("*", F.explode(F.sequence(F.col("p") + 1, F.col("v"))).alias("d"))
    nothing = hashlib.sha256(b"").hexdigest()
    return deep.select(
        F.col("id").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == 0, None).when(F.col("d") == F.col("p") + 1, F.col("parent_id")).otherwise(F.col("id")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("d") == F.col("v"), F.col("children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.coalesce(F.get("bytes", F.col("d") - 1), F.lit(0))).alias("saved_tokens"), F.when(F.col("d") == F.col("whole"), F.col("ends")).otherwise(nothing).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations of (conv_id, turn, role, text)."""
    return trie(rebuilt(turns(rows)))
