"""Removal of long repeated strings by sparse suffix sorting: a byte goes when some string of `length` bytes that covers it
also starts anywhere else in the corpus.

Sorting every suffix would move the corpus many times over. Instead a string's least `gram`-byte hash names its anchor:
equal strings have their anchors at the same place, so only suffixes at anchors (about one in 90 bytes) need comparing, and
neighbouring strings share an anchor and form one stretch.

1. Anchors meet by their gram. Unique ones, most of all, end here; stretches that are the same as a whole are repeats.
2. The other stretches, whose gram repeats in another surrounding, are written as suffixes from the anchor, sorted in each
   task, front-coded, exchanged by gram as sorted runs and merged by a loser tree. A head's common prefix with the last
   winner is known from its run, so no known prefix is compared again. The merged common prefixes rule out what can't reach
   `length`; the strings of the rest are compared byte by byte inside their gram.
3. Grams with more than `hot` such stretches are not merged in one place. Their strings are taken in blocks of like distance
   from the anchor, whose common core is counted by 128-bit fingerprints: where a core stands once, no string around it
   repeats. The strings around the other cores are counted by fingerprints; those that repeat within a task are found there,
   and one of each goes on to the exchange.
4. The places found come back to their documents, in which the covered bytes are cut.

A task sends no more than 64 stretches of one gram in step 1 and settles whole repeats on the spot, so what meets there for
one gram is bounded by the count of tasks.

Defined results: a null text is empty; matches never cross documents; rows with the same id and text are treated alike and
repeat each other; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, saved, text_or_empty
from .hashing import Powers, mix

LENGTH, GRAM = 200, 24
_PLACE = np.uint64((1 << 24) - 1)
#: Longest piece hashed at once; longer texts are read in overlapping pieces.
PIECE = 1 << 22


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches(data: np.ndarray, powers: Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor's gram hash, fingerprint, first start, last start, anchor) of the stretches of string starts with one anchor."""
    parts = []
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[at : at + PIECE + length - 1]
        if len(piece) < length:
            continue
        a, b = powers.sums(piece, 0), powers.sums(piece, 1)
        i = np.arange(len(piece) - gram + 1)
        grams = powers.ranges(a, i, i + gram, 0)
        keyed = (grams & ~_PLACE) | i.astype(np.uint64)  # of equal grams the leftmost
        anchor = (_slide_min(keyed, length - gram + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        anchor = anchor[first]
        shape = ((anchor - first) << 16 | last - first).astype(np.uint64)
        print_ = mix(powers.ranges(a, first, last + length, 0) + mix(powers.ranges(b, first, last + length, 1) + shape))
        parts.append((grams[anchor].view(np.int64), print_.view(np.int64), first + at, last + at, anchor + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 5


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


# Step 1

_ANCHOR = "gram bigint, print bigint, uid bigint, place bigint, kind tinyint, part bigint"
ONCE, MANY, REPEAT, PARTIAL, PROOF = 0, 1, 2, 3, 4


def _send(gram, print_, uid, place, kind, part) -> Iterator[pa.RecordBatch]:
    kind = np.broadcast_to(np.asarray(kind, np.int8), gram.shape)
    for i in range(0, len(gram), 65_536):
        j = slice(i, i + 65_536)
        yield pa.RecordBatch.from_arrays([pa.array(x[j]) for x in (gram, print_, uid, place, kind, part)], names=["gram", "print", "uid", "place", "kind", "part"])


def _grouped(gram: np.ndarray, print_: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order by gram and fingerprint; where a new fingerprint and where a new gram begins; rows of each row's fingerprint."""
    order = np.lexsort((print_, gram))
    g, p = gram[order], print_[order]
    new_g = np.ones(len(g), bool)
    new_g[1:] = g[1:] != g[:-1]
    new_p = new_g.copy()
    new_p[1:] |= p[1:] != p[:-1]
    ids = np.cumsum(new_p) - 1
    return order, new_p, new_g, ids


def anchors(docs: DataFrame, length: int, gram: int, most: int = 64) -> DataFrame:
    """`docs` (uid, text). Rows (gram, uid, place, kind) of stretches that repeat (REPEAT), may repeat in part (PARTIAL), or
    repeat and stand in a gram that others share (PROOF). place: first start << 16 | last - first << 8 | anchor - first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, cols = Powers(), [[], [], [], []]
        for b in batches:
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g, p, first, last, anchor = stretches(np.frombuffer(_bytes(text), np.uint8), powers, length, gram)
                for c, x in zip(cols, (g, p, np.full(len(g), uid, np.int64), first << 16 | last - first << 8 | anchor - first), strict=True):
                    c.append(x)
        if not cols[0]:
            return
        g, p, uid, place = map(np.concatenate, cols)
        order, new_p, new_g, ids = _grouped(g, p)
        g, p, uid, place = g[order], p[order], uid[order], place[order]
        many = np.bincount(ids)[ids] > 1
        yield from _send(*(x[many] for x in (g, p, uid, place)), REPEAT, uid[many])
        # Of each fingerprint one row goes on; of a gram no more than `most`, the others may repeat in part.
        rank = ids - ids[np.maximum.accumulate(np.where(new_g, np.arange(len(g)), 0))] if len(g) else ids
        go = new_p & (rank < most)
        yield from _send(*(x[go] for x in (g, p, uid, place)), np.where(many[go], MANY, ONCE), g[go])
        rest = new_p & ~go & ~many
        yield from _send(*(x[rest] for x in (g, p, uid, place)), PARTIAL, uid[rest])
        rest = new_p & ~go & many
        yield from _send(*(x[rest] for x in (g, p, uid, place)), PROOF, uid[rest])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], [], []]
        for b in batches:
            got = [c.to_numpy() for c in b.columns[:5]]
            done = got[4] > MANY
            if done.any():
                yield from _send(*(x[done] for x in got), got[2][done])
            for c, x in zip(cols, got, strict=True):
                c.append(x[~done])
        if not cols[0]:
            return
        g, p, uid, place, kind = map(np.concatenate, cols)
        order, new_p, new_g, ids = _grouped(g, p)
        g, p, uid, place, kind = (x[order] for x in (g, p, uid, place, kind))
        twice = (np.bincount(ids)[ids] > 1) | (np.bincount(ids, kind == MANY)[ids] > 0) if len(g) else new_p
        gram_ids = np.cumsum(new_g) - 1
        prints = np.bincount(gram_ids, new_p)[gram_ids] if len(g) else ids
        single = np.bincount(gram_ids, ~twice & new_p)[gram_ids] > 0 if len(g) else new_p
        yield from _send(*(x[twice & (kind == ONCE)] for x in (g, p, uid, place)), REPEAT, uid[twice & (kind == ONCE)])
        part = ~twice & (prints > 1)
        yield from _send(*(x[part] for x in (g, p, uid, place)), PARTIAL, uid[part])
        # A gram that tasks have cut short has further members; its rows all prove.
        proof = twice & new_p & (single | (prints >= most))
        yield from _send(*(x[proof] for x in (g, p, uid, place)), PROOF, uid[proof])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = docs.mapInArrow(find, _ANCHOR).repartition(parts, "part")
    return sent.mapInArrow(meet, _ANCHOR).select("gram", "uid", "place", "kind")


# Step 2


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of strings that are known to share `known` bytes; those are not looked at."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n  # a[known:lo] equal, a mismatch before hi
    step = 8
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(n, lo + step)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Run:
    """A front-coded sorted run, read string by string. A record: common prefix with the one before, tail, payload."""

    def __init__(self, records: Iterator[tuple[int, bytes, tuple]]):
        self.records, self.head, self.shared, self.payload = iter(records), b"", 0, None
        self.step()

    def step(self) -> None:
        record = next(self.records, None)
        if record is None:
            self.head = None
        else:
            self.shared, tail, self.payload = record
            self.head = self.head[: self.shared] + tail


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the string before, string, payload) of all runs in order, by a loser tree. A head carries its
    common prefix with the last winner; the longer one wins unseen, and only equal ones are compared, behind them."""
    runs = [r for r in runs if r.head is not None]
    k = len(runs)
    if not k:
        return

    def beats(i: int, j: int) -> bool:
        """Whether run i's head goes before run j's; the loser's prefix is then what it shares with the winner."""
        a, b = runs[i], runs[j]
        if a.head is None or b.head is None:
            return b.head is None
        if a.shared != b.shared:
            return a.shared > b.shared
        n = common_prefix(a.head, b.head, a.shared)
        first = a.head[n:] <= b.head[n:] if n < min(len(a.head), len(b.head)) else len(a.head) <= len(b.head)
        (b if first else a).shared = n
        return first

    for r in runs:
        r.shared = 0
    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        i, j = play(2 * node), play(2 * node + 1)
        if beats(i, j):
            losers[node] = j
            return i
        losers[node] = i
        return j

    winner = play(1) if k > 1 else 0
    while runs[winner].head is not None:
        r = runs[winner]
        yield r.shared, r.head, r.payload
        r.step()
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def front_code(rows: list[tuple[bytes, tuple]]) -> list[tuple[int, bytes, tuple]]:
    out, before = [], b""
    for s, payload in sorted(rows, key=lambda x: x[0]):
        n = common_prefix(before, s)
        out.append((n, s[n:], payload))
        before = s
    return out


_RUN = pa.struct([("shared", pa.int32()), ("tail", pa.binary()), ("left", pa.binary()), ("uid", pa.int64()), ("first", pa.int64()), ("open", pa.bool_())])
_BLOCK = pa.struct([("uid", pa.int64()), ("start", pa.int64()), ("open", pa.bool_()), ("body", pa.binary())])
_RUNS = "part bigint, run array<struct<shared:int,tail:binary,left:binary,uid:bigint,first:bigint,open:boolean>>, mark1 bigint, mark2 bigint, blocks array<struct<uid:bigint,start:bigint,open:boolean,body:binary>>"
_STRINGS = "mark1 bigint, mark2 bigint, uid bigint, start bigint, last bigint, open boolean"
#: Blocks of one core in a row, and in an Arrow batch.
IN_ROW, IN_BATCH = 1024, 4096
_FOUND = "uid bigint, start bigint, last bigint"


def _windows(rows: list[tuple], length: int) -> list[tuple[int, int, int]]:
    """(uid, first, last) string starts that repeat, among the sorted stretches of one gram: (shared, right, left, uid, first,
    open), right from the anchor on, left before it and reversed. Common prefixes with the neighbours in order bound those
    with all others; stretches that can't reach `length` with them are done."""
    seen: dict[bytes, tuple[int, int] | None] = {}
    hits: list[tuple[int, int]] = []
    for i, (shared, right, left, uid, first, wanted) in enumerate(rows):
        best = max(shared - 8 if i else 0, rows[i + 1][0] - 8 if i + 1 < len(rows) else 0)
        before, n = len(left), len(right) - length
        if best + before < length:
            continue
        whole = left[::-1] + right
        for o in range(before + n + 1):
            if before - o + best < length:  # this start and all after it reach less far left than they must
                break
            s = whole[o : o + length]
            old = seen.get(s, 0)
            if old == 0:
                seen[s] = (uid, first + o) if wanted else None
            else:
                if old is not None:
                    hits.append(old)
                    seen[s] = None
                if wanted:
                    hits.append((uid, first + o))
    out: list[tuple[int, int, int]] = []
    for uid, x in sorted(set(hits)):
        if out and out[-1][0] == uid and out[-1][2] == x - 1:
            out[-1] = (uid, out[-1][1], x)
        else:
            out.append((uid, x, x))
    return out


def blocks(first: int, n: int, anchor: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first start, last start, core's start, core's end) of the blocks of a stretch, whose n + 1 strings from `first` on share the
    anchor. A block holds the starts whose distance from the anchor has one quotient by its size, so that equal strings of two
    stretches stand in equal blocks; all strings of a block, in this stretch or another, hold its core."""
    size = max(1, length // 12)
    for b in range((anchor - first - n) // size, (anchor - first) // size + 1):
        near, far = b * size, b * size + size - 1
        yield max(first, anchor - far), min(first + n, anchor - near), anchor - near, anchor - far + length


def _runs_of(mark1: np.ndarray, mark2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both marks, and where in it a new pair of marks begins."""
    order = np.lexsort((mark2, mark1))
    a, b = mark1[order], mark2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, new


def crowded_repeats(cores: DataFrame, length: int) -> DataFrame:
    """(uid, start, last) of string starts that repeat, among the strings of `cores` (mark1, mark2, task, blocks)."""
    # Each task's blocks meet only what is told of their core, so a core that many tasks hold gathers nowhere.
    often = cores.groupBy("mark1", "mark2").agg(F.sum(F.size("blocks")).alias("n"), F.collect_set("task").alias("tasks"))
    often = often.where("n > 1").select("mark1", "mark2", F.explode("tasks").alias("task"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, marks = Powers(), []
        for b in batches:
            uid, start, wanted = (c.to_numpy(zero_copy_only=False) for c in b.columns[:3])
            bodies = b.column(3).to_pylist()
            size = np.fromiter(map(len, bodies), np.int64, len(bodies))
            many = size - length + 1
            of = np.repeat(np.arange(len(bodies)), many)
            o = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            raw, at = np.frombuffer(b"".join(bodies), np.uint8), (np.cumsum(size) - size)[of] + o
            m = [powers.ranges(powers.sums(raw, w), at, at + length, w).view(np.int64) for w in (0, 1)]
            marks.append((*m, uid[of], start[of] + o, wanted[of].astype(bool)))
        if not marks:
            return
        m1, m2, uid, at, wanted = map(np.concatenate, zip(*marks, strict=True))
        order, new = _runs_of(m1, m2)
        m1, m2, uid, at, wanted = (x[order] for x in (m1, m2, uid, at, wanted))
        twice = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if len(new) else new
        names = ["mark1", "mark2", "uid", "start", "last", "open"]
        # Strings that repeat in this task are found; one of each goes on.
        done = np.flatnonzero(twice & wanted)
        done = done[np.lexsort((at[done], uid[done]))]
        if len(done):  # neighbouring starts as one row
            u, x = uid[done], at[done]
            head = np.ones(len(done), bool)
            head[1:] = (u[1:] != u[:-1]) | (x[1:] > x[:-1] + 1)
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(done)) - 1
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(u[first]), pa.array(x[first]), pa.array(x[last]), pa.nulls(len(first), pa.bool_())], names=names)
        one = np.flatnonzero(new)
        for i in range(0, len(one), 65_536):
            j = one[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (m1[j], m2[j], uid[j], at[j], at[j], wanted[j] & ~twice[j])], names=names)

    sent = saved(cores.join(often, ["task", "mark1", "mark2"]).select(F.inline("blocks")).mapInArrow(spell, _STRINGS))
    strings = sent.where("mark1 is not null")
    twice = strings.groupBy("mark1", "mark2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark1", "mark2")
    counted = strings.where("open").join(twice, ["mark1", "mark2"])
    return counted.unionByName(sent.where("mark1 is null")).select("uid", "start", "last")


def partial_repeats(docs: DataFrame, found: DataFrame, length: int, hot: int) -> DataFrame:
    """(uid, start, last) of string starts that repeat within stretches that don't as a whole."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = found.where(F.col("kind") >= PARTIAL)
    crowded = saved(todo.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("gram", F.lit(True).alias("hot")))
    some_crowded = not crowded.isEmpty()
    item = F.struct("gram", "place", (F.col("kind") == PARTIAL).alias("open"), F.coalesce("hot", F.lit(False)).alias("hot"))
    todo = saved(todo.join(crowded, "gram", "left").groupBy("uid").agg(F.collect_set(item).alias("items")))
    rows = docs.join(todo, "uid").select("uid", "text", "items")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, by_part, marks, crowd = Powers(), {}, [], []
        for b in batches:
            for uid, text, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _bytes(text)
                cores = []
                for x in items:
                    first, n, a = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                    if x["hot"]:
                        for start, last, *core in blocks(first, n, first + a, length):
                            cores.append(core)
                            crowd.append((uid, start, x["open"], data[start : last + length]))
                        continue
                    key = (x["gram"] + (1 << 63)).to_bytes(8, "big") + data[first + a : first + n + length]
                    by_part.setdefault(x["gram"] % parts, []).append((key, (data[first : first + a][::-1], uid, first, x["open"])))
                if cores:
                    raw, at = np.frombuffer(data, np.uint8), np.array(cores)
                    marks.append([powers.ranges(powers.sums(raw, w), at[:, 0], at[:, 1], w).view(np.int64) for w in (0, 1)])
        names = ["part", "run", "mark1", "mark2", "blocks"]
        for part, strings in by_part.items():
            run = [{"shared": n, "tail": tail, "left": p[0], "uid": p[1], "first": p[2], "open": p[3]} for n, tail, p in front_code(strings)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([run], pa.list_(_RUN)), *(pa.nulls(1, pa.int64()),) * 2, pa.nulls(1, pa.list_(_BLOCK))], names=names)
        if marks:
            m1, m2 = map(np.concatenate, zip(*marks, strict=True))
            order, new = _runs_of(m1, m2)
            at = np.flatnonzero(new)
            # Rows of a core's blocks, with this task's number, as many as fit a batch.
            rows = [(i, min(i + IN_ROW, e)) for first, e in zip(at, np.append(at[1:], len(new)), strict=True) for i in range(first, e, IN_ROW)]
            task = TaskContext.get().partitionId()
            some, held = [], 0
            for i, e in rows:
                some.append((i, e))
                held += e - i
                if held >= IN_BATCH or e == len(new):
                    body = [[dict(zip(("uid", "start", "open", "body"), crowd[k], strict=True)) for k in order[i:e]] for i, e in some]
                    of = order[[i for i, _ in some]]
                    yield pa.RecordBatch.from_arrays([pa.array([task] * len(some), pa.int64()), pa.nulls(len(some), pa.list_(_RUN)), pa.array(m1[of]), pa.array(m2[of]), pa.array(body, pa.list_(_BLOCK))], names=names)
                    some, held = [], 0

    sent = rows.mapInArrow(write, _RUNS)
    if some_crowded:
        sent = saved(sent)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[Run]] = {}
        for b in batches:
            for part, run in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by_part.setdefault(part, []).append(Run(_records(run.values)))
        for part in list(by_part):
            out, group, gram = [], [], None
            for shared, s, (left, uid, first, wanted) in merge(by_part.pop(part)):
                if s[:8] != gram:
                    out += _windows(group, length)
                    group, gram = [], s[:8]
                group.append((shared, s[8:], left, uid, first, wanted))
            out += _windows(group, length)
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "start", "last"])

    runs = sent.where("run is not null").select("part", "run").repartition(parts, "part").mapInArrow(read, _FOUND)
    if not some_crowded:
        return runs
    return runs.unionByName(crowded_repeats(sent.where("run is null").select(F.col("part").alias("task"), "mark1", "mark2", "blocks"), length))


def _records(run: pa.StructArray) -> Iterator[tuple[int, bytes, tuple]]:
    cols = [run.field(i) for i in range(6)]
    for i in range(0, len(run), 4096):
        for shared, tail, left, uid, first, wanted in zip(*(c.slice(i, 4096).to_pylist() for c in cols), strict=True):
            yield shared, tail, (left, uid, first, wanted)


# The operator


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = 2000) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, spans (array of [start, end) in bytes), kept (binary)."""
    if not gram < length <= 255:
        raise ValueError("gram < length <= 255")
    arrow_rows(docs.sparkSession)
    keyed = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("uid", F.xxhash64("id", "text"))
    bodies = keyed.select("uid", "text")
    found = saved(anchors(bodies, length, gram))
    place, n = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255)
    whole = found.where(F.col("kind") == REPEAT).select("uid", place.alias("start"), (place + n).alias("last"))
    parts = whole.unionByName(partial_repeats(bodies, found, length, hot))
    spans = saved(parts.groupBy("uid").agg(F.collect_set(F.struct("start", "last")).alias("found")))
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = []
            for text, got in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, merged = _bytes(text), []
                for x in sorted(got or [], key=lambda x: x["start"]):
                    a, e = x["start"], x["last"] + length
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([a, e])
                kept, at = [], 0
                for a, e in merged:
                    kept.append(data[at:a])
                    at = e
                kept.append(data[at:])
                rows.append((len(data), sum(e - a for a, e in merged), len(merged), [{"start": a, "end": e} for a, e in merged], b"".join(kept)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return keyed.join(spans, "uid", "left").select("id", "text", "found").mapInArrow(cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
