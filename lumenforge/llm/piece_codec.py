"""Encoding by merges of scored pieces, and decoding, in Arrow batches.

The vocabulary of a merge-type model is a list of pieces with scores. A text starts as its characters; an agenda holds every
adjacent pair whose join is a piece, the highest score first and the leftmost of equals. The first pair is merged, its two
new neighbours join the agenda, entries whose parts have changed since are passed over, and the agenda's end leaves the
pieces. Characters that aren't pieces become their bytes, where the model has pieces for bytes, and else the unknown piece, one
for a run of them.

A pair can only be merged where some piece holds its two characters side by side. So texts are cut, exactly, where none
does: first before and after characters that no longer piece holds and, if no piece has a blank sign after another character,
before each run of blank signs. The agenda runs once for each different part of many texts; they are kept up to `KEPT`
characters, then forgotten.

In each Arrow batch the sentencepiece library encodes every part that is new to the worker as well. The returned ids are those
of the agenda, and `agrees` tells whether the library gives the same ones for all parts of the text. Decoding is the library's.

Defined results: a null text is empty and gives the end id alone; rows with the same id are texts of their own; an empty table
gives no rows; further columns stay. Models of other types, with pieces that stand for themselves (user-defined) or that are
out of use are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, text_or_empty

MODEL = "piece_bpe_32k.model"
#: Characters of different parts that a Python worker keeps the ids of.
KEPT = 24_000_000
#: Characters up to which an agenda is a list in the order of the text, whose highest score is sought; longer ones are heaps.
FEW, NEVER = 32, float("-inf")
#: Fixed value: the sign that stands for a blank in pieces.
SIGN = "▁"


def merged(part: str, scores: dict[str, float]) -> list[str]:
    """The pieces of `part`: characters whose pairs are merged by score, the leftmost of equals first."""
    n = len(part)
    own = list(part)
    if n <= FEW:  # the agenda in the order of the text
        held = [scores.get(x, NEVER) for x in map(add, part, part[1:])]
        while held and (best := max(held)) != NEVER:
            i = held.index(best)
            own[i] = both = own[i] + own.pop(i + 1)
            del held[i]
            if i < len(held):
                held[i] = scores.get(both + own[i + 1], NEVER)
            if i:
                held[i - 1] = scores.get(own[i - 1] + both, NEVER)
        return own
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda = [(-s, i, 2) for i in range(n - 1) if (s := scores.get(part[i : i + 2])) is not None]
    heapify(agenda)
    while agenda:
        _, i, size = heappop(agenda)
        j = after[i]
        # Stale: the left part is gone, or either has grown since.
        if not own[i] or j >= n or len(own[i]) + len(own[j]) != size:
            continue
        own[i] += own[j]
        own[j] = ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (s := scores.get(own[i] + own[k])) is not None:
                heappush(agenda, (-s, i, len(own[i]) + len(own[k])))
        if (h := before[i]) >= 0 and (s := scores.get(own[h] + own[i])) is not None:
            heappush(agenda, (-s, h, len(own[h]) + len(own[i])))
    return [x for x in own if x]


class Codec:
    """A model's vocabulary, and the ids of the parts seen so far."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kind = type(model.pieces[0]) if model.pieces else sentencepiece_model_pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE:
            raise ValueError("the model is not of the merge type")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL]
        self.ids = {p.piece: i for i, p in normal}
        self.scores = {p.piece: p.score for _, p in normal if len(p.piece) > 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()
        self.side_by_side = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.parts = self.cutter(sorted({c for pair in self.side_by_side for c in pair}))
        model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = False
        self.checker = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())  # for parts of normalised texts
        self.forget()

    def cutter(self, joiners: list[str]):
        """Finds the parts of a text: words of letters that no sign ever follows in a piece, where none of theirs does join the next
        character; else what stands between blank signs; characters that join nothing by themselves."""
        group = lambda cs: "".join(map(re.escape, cs))
        if not joiners:
            return re.compile(".", re.S).findall
        if any(pair[0] != SIGN and pair[1] == SIGN for pair in self.side_by_side):  # blank signs within pieces
            return re.compile(f"[{group(joiners)}]+|[^{group(joiners)}]").findall
        plain = group(c for c in joiners if c != SIGN)
        followed = {pair[0] for pair in self.side_by_side if not pair[1].isalpha()}
        letters = [c for c in joiners if c.isalpha() and c not in followed]
        after = sorted({pair[1] for pair in self.side_by_side if pair[0] in set(letters)})
        word = f"{SIGN}*+[{group(letters)}]++(?![{group(after)}])|" if letters and after else ""
        return re.compile(f"{word}{SIGN}*[{plain}]+|{SIGN}+|[^{plain}]").findall

    def forget(self) -> None:
        self.kept = Kept(self.add)
        self.fresh: list[str] = []
        self.wrong: set[str] = set()
        self.room = KEPT

    def check(self) -> None:
        """What has been kept since the last check, by the library."""
        given = self.checker.encode(self.fresh, num_threads=1) if self.fresh else []
        self.wrong.update(p for p, x in zip(self.fresh, given, strict=True) if array("i", x).tobytes() != self.kept[p])
        self.fresh = []

    def part_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for piece in merged(part, self.scores):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def add(self, part: str) -> bytes:
        """The ids of a part, which are kept."""
        self.fresh.append(part)
        self.room -= len(part) + 32
        return array("i", self.part_ids(part)).tobytes()

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        """Of each text the ids by the agenda, the end id last, and whether the library agrees."""
        return [(ids.tolist(), agrees) for ids, agrees in self.coded(texts)]

    def coded(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """`encode`, with ids as arrays."""
        if self.room < 0:
            self.forget()
        end, of = array("i", [self.end]).tobytes(), self.kept.__getitem__
        cut = [self.parts(self.library.normalize(t)) for t in texts]
        coded = [np.frombuffer(b"".join(map(of, parts)) + end, np.int32) for parts in cut]
        self.check()
        out = []
        for parts, ids in zip(cut, coded, strict=True):
            if not self.bytes:  # a run of unknown characters is one
                again = (ids == self.unknown) & (np.concatenate([[-1], ids[:-1]]) == self.unknown)
                ids = ids[~again]
            out.append((ids, not self.wrong or self.wrong.isdisjoint(parts)))
        return out


class Kept(dict):
    """Ids of parts, as packed 32-bit integers; `make` gives those that aren't kept yet."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, part: str) -> bytes:
        out = self[part] = self.make(part)
        return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each model and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode(rows: DataFrame, model: str | None = None, text: str = "text", into: str = "pieces") -> DataFrame:
    """`rows` with a column `into`: struct of ids (the end id last), decoded (text of the ids) and agrees (whether the library
    gives the same ids). `model` is a path that every executor has."""
    path = model or default_model()
    arrow_rows(rows.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            own = codec(path)
            ids, agrees = zip(*own.coded(list(texts)), strict=True) if len(texts) else ((), ())
            yield pd.DataFrame({"ids": list(ids), "decoded": [own.library.decode(x.tolist()) for x in ids], "agrees": list(agrees)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    coded = F.pandas_udf(run, "ids array<int>, decoded string, agrees boolean")
    return rows.withColumn(into, coded(text_or_empty(text)))
