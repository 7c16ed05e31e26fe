"""Packing tokens into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised where they are read and packed in blocks of `block_windows` windows, in the order of the rows of
their partition, or of fewer once they hold `BLOCK_PIECES` documents, so nothing is shuffled and a task holds one block at a time. In a block each document first fills whole
windows; what remains is differenced into near-equal windows, whose count rises whenever one exceeds the capacity. As
documents may be cut, the emptiest windows then fill up the others and what is left of them joins the next block. So every
sequence is full but a task's last ones: these are at most twelve short ones whose lengths are powers of two, which are not
padded. A corpus of n tasks has thus at most 12 n short sequences.

Rows must come in the same order when a lost task runs again, as they do from files; write a shuffled input first.

Defined results: a null text is empty and gives the end token alone; rows with the same id are documents of their own; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_rows, giving_back

CAPACITY = 4096
#: Pieces of a block, which short texts reach before its windows.
BLOCK_PIECES = 1 << 15
TOKENIZER = "word_bpe_49k.json"


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Indices of `lengths` in k groups of near-equal sums. A partial partition holds its sums in falling order, those that are not 0
    alone; the two with the largest differences are merged, the largest sum of one with the smallest of the other, until one is
    left."""
    if not lengths:
        return [[] for _ in range(k)]
    fall = lambda entry: -entry[0]
    heap = [(-n if k > 1 else 0, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    serial = count(len(lengths))
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        alone, other = max(k - len(b), 0), max(k - len(a), 0)  # of each, the sums that meet a 0
        met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone:], reversed(b[other:]), strict=True)] if len(a) + len(b) > k else []
        sums = sorted(a[:alone] + met + b[:other], key=fall)
        heapq.heappush(heap, ((sums[-1][0] if len(sums) == k else 0) - sums[0][0], next(serial), sums))
    trees = [x[1] for x in heap[0][2]]
    out = []
    for tree in trees + [None] * (k - len(trees)):
        group, stack = [], [] if tree is None else [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                group.append(x)
        out.append(sorted(group))
    return out


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


Piece = tuple[int, int, int]  # document, start, length


def near_equal_windows(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of near-equal sums by differencing. There are as many as the tokens need at least; whenever one exceeds the
    capacity, the count rises by one and all is differenced anew. No piece may exceed the capacity."""
    lengths = [x[2] for x in pieces]
    k = -(-sum(lengths) // capacity)
    while True:
        groups = differencing(lengths, k)
        if all(sum(lengths[i] for i in g) <= capacity for g in groups):
            return [[pieces[i] for i in g] for g in groups]
        k += 1


def pack_block(pieces: list[Piece], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences of the pieces, and what is left of them, which is less than a sequence.

    A piece first fills whole sequences by itself. What remains is differenced into near-equal windows; the emptiest of
    these, as many as the tokens can do without, are cut up to fill the others, and what is still left of them goes on."""
    out: list[list[Piece]] = []
    rest: list[Piece] = []
    for d, at, n in pieces:
        whole = n // capacity * capacity
        out += [[(d, at + i, capacity)] for i in range(0, whole, capacity)]
        if n > whole:
            rest.append((d, at + whole, n - whole))
    if sum(x[2] for x in rest) < capacity:
        return out, rest
    windows = sorted(near_equal_windows(rest, capacity), key=lambda w: -sum(x[2] for x in w))
    full = sum(x[2] for x in rest) // capacity
    spare = [x for w in windows[full:] for x in w]
    for w in windows[:full]:
        room = capacity - sum(x[2] for x in w)
        while room:
            d, at, n = spare.pop()
            w.append((d, at, min(n, room)))
            if n > room:
                spare.append((d, at + room, n - room))
            room -= w[-1][2]
    return out + windows[:full], spare


def short_sequences(pieces: list[Piece]) -> list[list[Piece]]:
    """The last pieces of a task in sequences whose lengths are powers of two, which are not padded."""
    out, rest = [], pieces[::-1]
    for size in powers_of_two(sum(x[2] for x in pieces)):
        seq: list[Piece] = []
        while size:
            d, at, n = rest.pop()
            seq.append((d, at, min(n, size)))
            if n > size:
                rest.append((d, at + size, n - size))
            size -= seq[-1][2]
        out.append(seq)
    return out


class TextIds:
    """Token ids of whole texts by any tokenizer, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


#: What a tokenizer file says of itself if `WordIds` may stand in for it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the end of a unit; no word that is encoded with it holds it.
_END = "\x01"
#: Words of the first blocks, in which every letter has one lower-case letter and composes with none beside it.
_COMMON = "^[!-~\u00a1-\u012f\u0131-\u017f]+$"


class WordIds(TextIds):
    """Token ids by a tokenizer of words with ends. It drops white space and never joins across it, so a text's ids are those
    of its words in turn: only the distinct words of some texts are encoded. Their units (letters, a digit, signs) are marked
    at their ends, and the same merges, which the file lists by rank, are applied to all of them in one go by a faster
    library. Words of rarer letters, and those that may hold a special token, are left to the tokenizer itself."""

    def __init__(self, path: str, model: dict):
        import tiktoken

        super().__init__(path)
        bytes_of = _bytes_of_characters()
        ranks = {bytes(bytes_of[c] for c in t.removesuffix("</w>")) + (_END.encode() if t.endswith("</w>") else b""): i for t, i in model["vocab"].items()}
        self.units = tiktoken.Encoding("units", pat_str=f"[^ {_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True

    def batch(self, texts: list[str]) -> list[bytes]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = words.flatten().dictionary_encode()
        common = pc.and_not(pc.match_substring_regex(coded.dictionary, _COMMON), pc.match_substring(coded.dictionary, "<|"))
        ids, at = self._common(pc.utf8_lower(coded.dictionary.filter(common)))
        more, further = self._others(coded.dictionary.filter(pc.invert(common)).to_pylist())
        order = np.argsort(np.argsort(~common.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        flat, at = np.concatenate([ids, more]), np.concatenate([at, further[1:] + len(ids)])
        number = order[coded.indices.to_numpy()]
        size = np.diff(at)[number]
        end = np.concatenate([[0], np.cumsum(size)])
        out = flat[np.repeat(at[number] - end[:-1], size) + np.arange(end[-1])]
        cuts = end[words.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def _common(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and where each one's begin."""
        marked = pc.replace_substring_regex(words, _UNITS, rf"\0{_END}")
        units = pc.count_substring(marked, _END).to_numpy()
        ids = self.units.encode_to_numpy(" ".join(marked.to_pylist())).astype("<u4")
        ends = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        return ids, ends[np.concatenate([[0], np.cumsum(units)])]

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the tokenizer: words as one text, told apart by their places."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        return np.array(got.ids, "<u4"), np.searchsorted(np.array([x for x, _ in got.offsets], np.int64), starts)


def _bytes_of_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: A Python worker's tokenizers: tasks that follow one another in it share them.
_LOADED: dict[str, TextIds] = {}


def ids_by(path: str) -> TextIds:
    """The tokenizer in a file, by words if the file says that it is of that form."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told.get("model") or {}, ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        words = model.get("end_of_word_suffix") == "</w>" and told.get("normalizer") == _NORMALIZER and split.get("pattern") == {"Regex": _UNITS}
        _LOADED[path] = WordIds(path, model) if words else TextIds(path)
    return _LOADED[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _gathered(batches: Iterator[pa.RecordBatch], letters: int = 2_000_000) -> Iterator[tuple[list, list[str], pa.DataType]]:
    """Ids and texts of several batches together: the more texts, the more of their words repeat."""
    keys, texts, held = [], [], 0
    for b in batches:
        keys += b.column(0).to_pylist()
        texts += [t or "" for t in b.column(1).to_pylist()]
        held += sum(map(len, texts[-len(b) :])) if len(b) else 0
        if held >= letters:
            yield keys, texts, b.column(0).type
            keys, texts, held = [], [], 0
    if keys:
        yield keys, texts, b.column(0).type


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 2, block_windows: int = 128, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian 32-bit), doc_tokens, sequence_id, offset."""
    arrow_rows(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ids_by(tokenizer or tokenizer_path())
        serial = count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36)
        held: dict[int, tuple] = {}  # id and token ids of the documents that have tokens left
        pieces: list[Piece] = []
        number, tokens, kind = count(), 0, None

        def rows_of(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            rows = []
            for seq in sequences:
                sid, offset = next(serial), 0
                for d, at, n in seq:
                    key, ids = held[d]
                    rows.append((key, at, n, ids[4 * at : 4 * (at + n)], len(ids) // 4, sid, offset))
                    offset += n
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            for i in range(0, len(rows), 2048):
                cols = zip(*rows[i : i + 2048], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for keys, texts, kind in _gathered(batches):
            for key, ids in zip(keys, words.batch(texts), strict=True):
                d = next(number)
                held[d] = (key, ids + end)
                pieces.append((d, 0, len(ids) // 4 + 1))
                tokens += pieces[-1][2]
                if tokens >= block_windows * capacity or (len(pieces) >= BLOCK_PIECES and tokens >= capacity):
                    full, pieces = pack_block(pieces, capacity)
                    yield from rows_of(full)
                    held = {x[0]: held[x[0]] for x in pieces}
                    tokens = sum(x[2] for x in pieces)
        full, pieces = pack_block(pieces, capacity)
        yield from rows_of(full + short_sequences(pieces))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
