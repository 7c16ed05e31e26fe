"""Headings, links and anchors of Markdown texts: one pass over a text's characters tells its parts, Spark joins them.

Follows the public CommonMark specification for fences, escapes, code spans, brackets, destinations and titles; a link does not
run over the end of its line. A text of any length is read once, from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .split import places

#: What a scan tells: `line`s outside fenced code, `heading`s, links' `target`s, `label`s that stand for one, `definition`s of labels.
PARTS = "array<struct<kind:string,line_no:int,text:string,target:string>>"


#: Round brackets that a bare destination may nest.
NESTED = 32


def _fence(line: str) -> tuple[str, int, str]:
    """(character, length, rest) of a line that starts with a fence, else an empty character."""
    body = line.lstrip(" ")
    mark = body[:1]
    if len(line) - len(body) > 3 or mark not in ("`", "~") or not mark:
        return "", 0, ""
    rest = body.lstrip(mark)
    return (mark, len(body) - len(rest), rest) if len(body) - len(rest) >= 3 else ("", 0, "")


def outside(text: str) -> Iterator[tuple[int, str]]:
    """(number, line) of the lines outside fenced code. Only a bare fence of the same character, as long or longer, closes one; an
    open one ends with the text. Fences of backticks have no backtick after them."""
    inside, width = "", 0
    for number, line in enumerate(text.replace("\r\n", "\n").split("\n")):
        mark, length, rest = _fence(line)
        if inside:
            if mark == inside and length >= width and not rest.strip():
                inside = ""
        elif mark and not (mark == "`" and "`" in rest):
            inside, width = mark, length
        else:
            yield number, line


def _after_code(line: str, at: int) -> int:
    """The end of a code span that starts at `at`, or of its backticks where nothing closes them."""
    n = len(line)
    end = at
    while end < n and line[end] == "`":
        end += 1
    fence = line[at:end]
    close = line.find(fence, end)
    while close >= 0:
        stop = close + len(fence)
        if (stop >= n or line[stop] != "`") and line[close - 1] != "`":
            return stop
        while stop < n and line[stop] == "`":
            stop += 1
        close = line.find(fence, stop)
    return end


def _skip(line: str, at: int) -> int:
    while at < len(line) and line[at] in " \t":
        at += 1
    return at


def _destination(line: str, at: int) -> tuple[str, int] | None:
    """A destination from `at`, in angle brackets or bare with balanced brackets, and the place after it."""
    n, depth, end = len(line), 0, at
    if line[at : at + 1] == "<":
        end += 1
        while end < n and line[end] not in "<>":
            end += 2 if line[end] == "\\" else 1
        return (line[at + 1 : end], end + 1) if line[end : end + 1] == ">" else None
    while end < n and line[end] > " ":
        c = line[end]
        if c == "\\":
            end += 1
        elif c == "(":
            depth += 1
            if depth > NESTED:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        end += 1
    end = min(end, n)
    return (line[at:end], end) if depth == 0 else None


def _title(line: str, at: int) -> int:
    """The place after a title from `at`, or `at` where none is."""
    closing = {'"': '"', "'": "'", "(": ")"}.get(line[at : at + 1])
    end = at + 1
    while closing and end < len(line) and line[end] != closing:
        end += 2 if line[end] == "\\" else 1
    return end + 1 if closing and end < len(line) else at


def _inline(line: str, at: int) -> tuple[str, int] | None:
    """Target of an inline link whose round bracket opens at `at`, and the place after it."""
    found = _destination(line, _skip(line, at + 1))
    if not found:
        return None
    target, end = found
    after = _skip(line, end)
    if after > end:
        after = _skip(line, _title(line, after))
    return (target, after + 1) if line[after : after + 1] == ")" else None


def links(line: str) -> Iterator[tuple[str, str]]:
    """(kind, value) of a line's links and images: `target` as written in place, or `label` that a definition may explain. What a
    label explains is only known with all definitions, so texts in square brackets are labels until then."""
    open_: list[int] = []
    at, n, latest, close = 0, len(line), -1, -1  # latest: the last opening bracket; close: the next ">"
    while at < n:
        c = line[at]
        if c == "\\":
            at += 2
        elif c == "`":
            at = _after_code(line, at)
        elif c == "<":
            if close < at:
                close = line.find(">", at)
                close = n if close < 0 else close
            plain = line[at + 1 : at + 9].lower().startswith(("http://", "https://", "mailto:")) and close < n
            body = line[at + 1 : close] if plain else ""
            if body and not any(x <= " " or x == "<" for x in body):
                yield "target", body
                at = close + 1
            else:
                at += 1
        elif c == "[":
            open_.append(at)
            latest = at
            at += 1
        elif c == "]" and open_:
            start, stop = open_.pop(), at
            at += 1
            following = line[at : at + 1]
            if following == "(" and (found := _inline(line, at)):
                yield "target", found[0]
                at = found[1]
            elif following == "[" and (end := line.find("]", at)) > 0 and "[" not in line[at + 1 : end]:
                yield "label", line[at + 1 : end].strip() or line[start + 1 : stop]
                at = end + 1
            elif latest == start and (label := line[start + 1 : stop]).strip():
                yield "label", label
        else:
            at += 1


def definition(line: str) -> tuple[str, str] | None:
    """(label, target) of a line that defines a label."""
    at = len(line) - len(line.lstrip(" "))
    end = line.find("]:", at)
    label = line[at + 1 : end]
    if at > 3 or line[at : at + 1] != "[" or end < 0 or not label.strip() or "[" in label or "]" in label:
        return None
    found = _destination(line, _skip(line, end + 2))
    return (label, found[0]) if found and found[1] > _skip(line, end + 2) else None


def heading(line: str) -> str:
    """The text of a heading of 1 to 6 signs, without closing signs; empty where the line is none."""
    body = line.lstrip(" ")
    text = body.lstrip("#")
    level = len(body) - len(text)
    if len(line) - len(body) > 3 or not 1 <= level <= 6 or text[:1] not in (" ", "\t"):
        return ""
    text = text.strip()
    bare = text.rstrip("#")
    return bare.rstrip() if bare != text and bare[-1:] in ("", " ", "\t") else text


def scan(text: str | None) -> list[dict]:
    """The parts of a text; a null one has none."""
    out = []
    add = lambda kind, no, value, target=None: out.append({"kind": kind, "line_no": no, "text": value, "target": target})
    for no, line in outside(text) if text is not None else ():
        add("line", no, line)
        if title := heading(line):
            add("heading", no, title)
        if found := definition(line):
            add("definition", no, *found)
        elif "[" in line or "<" in line:
            for kind, value in links(line):
                add(kind, no, value if kind == "label" else None, value if kind == "target" else None)
    return out


def parts(files: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = ("line",)) -> DataFrame:
    """(key, kind, line_no, text, target) of the parts of these kinds."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[p for p in scan(t) if p["kind"] in kinds] for t in texts])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return files.select(key, F.inline(F.pandas_udf(run, PARTS)(F.col(text))))


def outside_fences(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line) of lines outside fenced code."""
    return parts(files, key, text).select(key, "line_no", F.col("text").alias("line"))


def slug(title: Column) -> Column:
    """The anchor of a heading: lower case, words without tags and signs, joined by hyphens; a first or last word of signs alone
    leaves its hyphen."""
    words = F.split(F.lower(F.trim(F.regexp_replace(title, "<[^>]*>", ""))), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"[^\p{L}\p{M}\p{N}_-]", ""))
    last = F.size(words) - 1
    return F.array_join(F.filter(bare, lambda w, i: (w != "") | (i == 0) | (i == last)), "-")


def heading_slugs(rows: DataFrame, keys: list[str], order: list[str], title: str) -> DataFrame:
    """With `anchor`: repeated slugs of a file get -1, -2, ... in order."""
    placed = places(rows.withColumn("slug", slug(F.col(title))), [*keys, "slug"], order, "place_of_slug")
    n = F.col("place_of_slug") - 1
    return placed.withColumn("anchor", F.when(n == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string")))).drop("place_of_slug")


def anchors(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, anchor) of the headings of Markdown files."""
    heads = parts(files, key, text, ("heading",)).select(key, "line_no", F.col("text").alias("heading"))
    return heading_slugs(heads, [key], ["line_no"], "heading").select(key, "anchor")


def markdown_links(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, target) of links, images and autolinks outside fenced code, and of labels that the file defines. A label is looked up
    without regard to case and blanks; its first definition holds."""
    found = parts(files, key, text, ("target", "label", "definition"))
    label = F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("label")
    defined = found.where("kind = 'definition'").groupBy(F.col(key), label).agg(F.min_by("target", "line_no").alias("target"))
    named = found.where("kind = 'label'").select(key, label).join(defined, [key, "label"])
    return found.where("kind = 'target'").select(key, "target").unionByName(named.select(key, "target"))
