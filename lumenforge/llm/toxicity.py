"""Toxicity by noisy-channel deobfuscation.

Tokens that don't read as plain words (leetspeak, letters set apart, repeated letters) become lattices of characters; a
Viterbi search finds the likeliest plain reading under a character trigram model of the whole corpus. The text as restored
is scored by a logistic regression on words and word beginnings, learned from labelled documents.

A word cut in two by a blank is read as one where the model finds that likelier and the classifier knows the word.

- The language model counts the characters of all documents. Its table has at most SYMBOLS ** 3 cells at any input size.
- The classifier is fitted on at most `labelled_rows` labelled documents (the first in the order of a hash of their id,
  from the learning folds alone) and `most_features` features; both bounds are parameters. Their ids are the only thing
  broadcast for it.
- Labels, language, source and id are no inputs of a score.

Defined results: a null text is empty; an empty text scores what a text without any feature does; rows with the same id
stay rows of their own; labels without id or class are left out, of several labels of a document the highest counts;
without labels of both classes every score is `prior`; an empty table gives an empty one; further columns are kept by
`with_scores`. Cost is linear in the length of a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched, compress, pairwise
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, giving_back, saved, text_or_empty

#: The symbols of the model. 0 is the edge of a word, the last one anything else.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
OTHER = len(LETTERS) + 1
SYMBOLS = OTHER + 1
_SYMBOL = np.full(0x180, OTHER, np.int64)
for _i, _c in enumerate(LETTERS):
    _SYMBOL[ord(_c)] = _i + 1
_SYMBOL[10] = 0
_INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a written sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "µ": "u",
}
#: Signs that may stand between the letters of a word and mean nothing.
GAPS = frozenset(".-_*~'`^·•,:;/\\#=\"")
_LEET_COST, _GAP_COST, _REPEAT_COST, _KEEP_COST, _SPLIT_COST, _CUT_COST = math.log(0.5), math.log(0.8), math.log(0.6), math.log(0.05), math.log(0.2), math.log(0.1)

_PLAIN = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
#: Three single signs or more, apart by blanks of any kind; signs may follow the last.
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S[.,:;!?]*(?!\S)")
_ENDS = ".,:;?#%&*()[]{}<>\"'`~^-_=/\\"


# The language model


def _trigrams(words: Counter, portion: int = 16_384) -> np.ndarray:
    """Counts of symbol trigrams in words, each between edges, as a flat table; so many words at a time, which take a few MB."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for some in batched(words.items(), portion):
        text = "\n\n" + "\n\n".join(w for w, _ in some) + "\n\n"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        sym = _SYMBOL[np.minimum(codes, 0x17F)]
        sym[codes == 10] = 0
        sym[codes == ord("œ")] = _INDEX["œ"]
        reps = np.fromiter((n for _, n in some), np.int64, len(some))
        lens = np.fromiter((len(w) for w, _ in some), np.int64, len(some)) + 2
        weight = np.repeat(reps, lens)  # of the trigrams that end in a word or at the edge after it
        tri = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
        total += np.bincount(tri[: len(weight)], weight, SYMBOLS**3).astype(np.int64)
    return total


def count_trigrams(texts: DataFrame, text_col: str) -> np.ndarray:
    """Over all texts. Each task sends the cells it has seen; they are added by Spark and at most SYMBOLS ** 3 collected."""
    arrow_rows(texts.sparkSession)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        words: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words.update((t or "").lower().split())
            if len(words) > 200_000:
                total += _trigrams(words)
                words.clear()
        if words:
            total += _trigrams(words)
        (cells,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells])], names=["cell", "n"])

    cells = texts.select(text_col).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SYMBOLS**3, np.int64)
    for r in cells:
        out[r.cell] = r.n
    return out


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), mixed with P(c | b) and P(c)."""
    n3 = counts.reshape((SYMBOLS,) * 3).astype(np.float64)
    n2 = n3.sum(axis=0)
    p1 = (n2.sum(axis=0) + 1) / (n2.sum() + SYMBOLS)
    p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
    p3 = (n3 + 20 * p2) / (n3.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32)


# The noisy channel


class Reader:
    """Reads tokens under a model; readings of tokens are kept, as many as `most`."""

    def __init__(self, model: np.ndarray, most: int = 200_000):
        self.p, self.most, self.seen = model.ravel().tolist(), most, {}
        self.choices: dict[tuple[str, bool, bool], list[tuple[str, float, list[int]]]] = {}

    def _choices(self, c: str, before: str, spaced: bool) -> list[tuple[str, float]]:
        if c.isspace():
            return [("", 0.0)]
        out = [(x, _LEET_COST) for x in LEET.get(c, "")]
        if c.isalpha():
            out.append((c, 0.0))
            if c == before:
                out.append(("", _REPEAT_COST))
            if spaced:
                out.append((" " + c, _SPLIT_COST))
        elif c in GAPS:
            out.append(("", _GAP_COST))
        if not out or c.isdigit():
            out.append((c, _KEEP_COST))
        return out

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest reading. A state is the last two symbols; a state keeps its best path."""
        # Keys are a * SYMBOLS + b.
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        before, p = "", self.p
        for c in token:
            after: dict[int, tuple[float, tuple]] = {}
            known = (c, c == before, spaced)
            if (choices := self.choices.get(known)) is None:
                choices = [(text, cost, [0 if x == " " else _INDEX.get(x, OTHER) for x in text]) for text, cost in self._choices(c, before, spaced)]
                if len(self.choices) < self.most:
                    self.choices[known] = choices
            for text, cost, syms in choices:
                if len(syms) == 1:
                    (x,) = syms
                    for ab, (score, path) in states.items():
                        s = score + cost + p[ab * SYMBOLS + x]
                        ab = ab % SYMBOLS * SYMBOLS + x
                        if (old := after.get(ab)) is None or old[0] < s:
                            after[ab] = (s, (path, text))
                    continue
                for ab, (score, path) in states.items():
                    s = score + cost
                    if syms and not ab % SYMBOLS:
                        continue
                    for x in syms:
                        s += p[ab * SYMBOLS + x]
                        ab = 0 if x == 0 else ab % SYMBOLS * SYMBOLS + x
                    if (old := after.get(ab)) is None or old[0] < s:
                        after[ab] = (s, (path, text) if text else path)
            states, before = after, c
        best = max(((s + p[ab * SYMBOLS], path) for ab, (s, path) in states.items()), key=lambda x: x[0])[1]
        parts = []
        while best:
            best, text = best
            parts.append(text)
        return "".join(reversed(parts))

    def readings(self, token: str) -> tuple[str, ...]:
        """The words a lower-case token stands for: itself without signs at its ends, and what it was before the noise."""
        got = self.seen.get(token)
        if got is None:
            got = self.read(token)
            if len(self.seen) < self.most:
                self.seen[token] = got
        return got

    def read(self, token: str) -> tuple[str, ...]:
        """`readings`, which keeps them."""
        if token.isalpha():  # plain, and nothing at its ends
            if not any(map(eq, token, token[1:])):
                return (token,)
            return tuple(dict.fromkeys((token, self.decode(token))))
        core = token.strip(_ENDS)
        plain = core.strip("!$@|+€£")
        words = [plain] if _PLAIN.fullmatch(plain) else []
        for x in (core,) if core == plain else (core, plain):
            if _noisy(x) and (y := self.decode(x)) not in words:
                words.append(y)
        return tuple(words or [plain] if plain else words)

    def likelihood(self, word: str) -> float:
        """The log probability of a word between edges."""
        a = b = 0
        total, p = 0.0, self.p
        for c in word:
            x = _INDEX.get(c, OTHER)
            total += p[(a * SYMBOLS + b) * SYMBOLS + x]
            a, b = b, x
        return total + p[(a * SYMBOLS + b) * SYMBOLS]

    def joined(self, left: str, right: str) -> bool:
        """Whether two neighbours read better as one word that a blank has cut in two."""
        return self.likelihood(left + right) + _CUT_COST > self.likelihood(left) + self.likelihood(right)

    def words(self, text: str) -> set[str]:
        """The distinct words of a text as restored."""
        low = text.lower()
        tokens = low.split()
        out: set[str] = set()
        for token in set(tokens):
            out.update(self.readings(token))
        for run in spaced_runs(low, tokens):
            out.update(self.decode(run, spaced=True).split())
        return out


def spaced_runs(low: str, tokens: list[str]) -> list[str]:
    """Runs of single signs; texts without two of them side by side aren't searched."""
    lens = list(map(len, tokens))
    return _SPACED.findall(low) if (1, 1) in zip(lens, lens[1:], strict=False) else []


def _noisy(token: str) -> bool:
    """Whether a token may be something else than it reads: it has letters, and signs or a repetition among them; or it has no
    letter, but three signs or more that stand for some, digits alone not counting."""
    if _LETTER.search(token):
        return not _PLAIN.fullmatch(token) or bool(_REPEATED.search(token))
    return sum(c in LEET for c in token) >= 3 and any(c in LEET and not c.isdigit() for c in token)


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:n]}~" for n in (4, 5) if len(word) > n))


# The classifier


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    intercept: float


def fold(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def learn(docs: DataFrame, labels: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled_rows: int = 30_000, most_features: int = 4096, least: int = 4, prior: float = 0.05) -> Classifier:
    """`model`: a broadcast of log_probabilities(). Rows of fold 2 are never read."""
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 2)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.orderBy(F.md5(F.col("id").cast("string")), "id", F.desc("y")).limit(labelled_rows).groupBy("id").agg(F.max("y").alias("y"))
    rows = saved(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(known), "id").select("y", "text"))
    classes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Classifier({}, math.log(prior / (1 - prior)))
    if min(classes.get(0, 0), classes.get(1, 0)) < 1:
        return none

    @giving_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.value)
        for b in batches:
            words = [sorted(reader.words(text)) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["y", "words"])

    rows = saved(rows.mapInArrow(read, "y int, words array<string>"))

    @giving_back
    def count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter = Counter()
        toxic: Counter = Counter()

        def rows_so_far() -> pa.RecordBatch:
            names = list(dict.fromkeys([*toxic, *clean]))
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([clean[x] for x in names], pa.int64())], names=["feature", "t", "c"])
            toxic.clear()
            clean.clear()
            return out

        for b in batches:
            for y, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                (toxic if y > 0 else clean).update({f for w in words for f in word_features(w)})
            if len(toxic) + len(clean) > 200_000:
                yield rows_so_far()
        yield rows_so_far()

    t, c, nt, nc = F.col("t"), F.col("c"), classes[1], classes[0]
    found = rows.mapInArrow(count_all, "feature string, t bigint, c bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((t + 0.5) / (nt + 1.0)) - F.log((c + 0.5) / (nc + 1.0))
    # Strong signs only: much likelier in toxic documents, ranked by how sure that is.
    best = found.where((t >= min(least, nt)) & (odds >= math.log(5.0))).orderBy(F.desc(odds * F.sqrt(t)), "feature").limit(most_features).select("feature").collect()
    if not best:
        return none
    index = {r.feature: i for i, r in enumerate(best)}
    held = spark.sparkContext.broadcast(index)

    @giving_back
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted({held.value[f] for w in words for f in word_features(w) if f in held.value}) for words in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int32()))], names=["y", "hits"])

    # The bounded sample of label and feature numbers.
    sample = rows.mapInArrow(hits, "y int, hits array<int>").toPandas()
    w, b0 = logistic(sample["hits"].tolist(), sample["y"].to_numpy() > 0, len(index))
    return Classifier({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-3}, b0)


def logistic(hits: list, y: np.ndarray, size: int, steps: int = 400, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """L2 logistic regression on presence features, by gradient descent with momentum over the bounded sample; weights stay
    at 0 or above, since every feature was chosen as a sign of toxicity."""
    lens = np.fromiter(map(len, hits), np.int64, len(hits))
    cols = np.fromiter((i for h in hits for i in h), np.int64, int(lens.sum()))
    rows = np.repeat(np.arange(len(hits)), lens)
    n, target = len(hits), y.astype(np.float64)
    w, v, b, vb = np.zeros(size), np.zeros(size), math.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6)), 0.0
    scale = 1.0 / np.sqrt(np.bincount(cols, minlength=size) / n + 1e-4)  # rare features take larger steps
    for _ in range(steps):
        z = np.bincount(rows, w[cols], n) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        v = 0.9 * v - 0.3 * scale * (np.bincount(cols, err[rows], size) / n + decay * w)
        vb = 0.9 * vb - 0.3 * err.mean()
        w, b = np.maximum(0.0, w + v), b + vb
    return w, float(b)


class Scorer:
    """Finds the weighted features of whole texts; those of tokens are kept, and which tokens have none, as many as `most`."""

    def __init__(self, reader: Reader, classifier: Classifier, most: int = 250_000):
        self.reader, self.weights, self.most = reader, classifier.weights, most
        self.of: dict[str, tuple[str, ...]] = {}
        self.nothing: set[str] = set()
        self.starts = {f[:n] for f in self.weights for n in range(1, len(f) + 1)}  # what a blank may have left of a word

    def of_words(self, words: Iterable[str]) -> list[str]:
        out = []
        for w in words:
            if w in self.weights:
                out.append(w)
            if len(w) > 4:
                out += [f for n in ((4, 5) if len(w) > 5 else (4,)) if (f := w[:n] + "~") in self.weights]
        return out

    def features(self, text: str) -> set[str]:
        low, found = text.lower(), set()
        tokens = low.split()
        distinct = set(tokens)
        if not self.starts.isdisjoint(distinct):
            for left, right in compress(pairwise(tokens), map(self.starts.__contains__, tokens)):
                if (both := left + right.rstrip(_ENDS)) in self.weights and self.reader.joined(left, both[len(left) :]):
                    found.add(both)
        for token in distinct - self.nothing:
            got = self.of.get(token)
            if got is None:
                got = tuple(self.of_words(self.reader.read(token)))
                if len(self.of) + len(self.nothing) < self.most:
                    if got:
                        self.of[token] = got
                    else:
                        self.nothing.add(token)
            found.update(got)
        for run in spaced_runs(low, tokens):
            found.update(self.of_words(self.reader.decode(run, spaced=True).split()))
        return found


def with_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "toxic_score", **how) -> DataFrame:
    """`docs` with a further column `into`, 0 to 1; it takes the place of one of that name."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(log_probabilities(count_trigrams(docs, text_col)))
    fitted = spark.sparkContext.broadcast(learn(docs, labels, model, id_col, text_col, **how))

    @F.arrow_udf("double")
    @giving_back
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, c = Reader(model.value), fitted.value
        scored = Scorer(reader, c)
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                z = c.intercept + sum(c.weights[f] for f in sorted(scored.features(text or "")))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.array(out, pa.float64())

    return docs.withColumn(into, score(text_or_empty(text_col)))
