"""Checks of text files as DataFrames: secret and path scans, links and anchors, claims, figures, tables."""

from __future__ import annotations

import re
import subprocess
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Folder
from .markdown import anchors, heading_slugs, markdown_links, outside_fences, slug

__all__ = [
    "EVIDENCE", "MORE_SCANS", "SCANS", "anchors", "broken_links", "claims", "evidence", "findings", "heading_slugs", "html_links", "lines", "markdown_links",
    "mismatched", "missing", "missing_headings", "outside_fences", "shown", "slug", "table_cells", "text_files", "tracked_files", "unbacked_rows", "url_map_problems",
]

#: What a scan looks for, by description and pattern; some patterns share a description.
SCANS: tuple[tuple[str, str], ...] = (
    ("an OAuth token", r"\bgho_[A-Za-z0-9]{20,}\b"),
    ("a personal access token", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("a personal access token", r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("an API key", r"\bsk-(?:[A-Za-z0-9]{20,}|proj-[A-Za-z0-9_-]{20,})\b"),
    ("an environment file", r"(?<![\w.\\])\.env(?![\w.-])"),
    ("a dataset folder", r"(?i)(?:[A-Z]:\\|/)(?:[^\\/\r\n]+[\\/])*mvtec(?:_anomaly_detection|[_ -]?ad)?(?:[\\/]|$)"),
    ("a temporary render folder", r"(?i)(?<![A-Za-z0-9_])tmp[\\/]pdfs[\\/]"),
    ("an unresolved link", r"(?i)\b(?:NOTION_CASE_STUDY_URL|notion(?:\s+case\s+study)?\s+(?:url|link))\s*:\s*(?:pending|tbd|todo)\b"),
    ("a user's folder", r"(?i)C:\\Users\\[A-Za-z0-9][A-Za-z0-9._-]*"),
)
#: Further patterns, of this library's own.
MORE_SCANS: tuple[tuple[str, str], ...] = (
    ("assigned secret", r"(?i)\b(?:api[_-]?key|secret|token|password)\s*[:=]\s*['\x22][A-Za-z0-9_\-]{12,}['\x22]"),
    ("cloud access key", r"AKIA[0-9A-Z]{16}"),
    ("private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("e-mail address", r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z]{2,}"),
    ("home folder", r"/(?:home|Users)/[A-Za-z0-9._-]+/"),
)
_FOLDER = r"mvtec(?:_anomaly_detection|[_ -]?ad)?"
#: Forms of patterns that find the same texts in one pass. Of a dataset folder: each slash starts a path, so only folders before
#: backslashes need following, up to the next start, and none is given back; Java's matcher would recurse for every folder.
ONE_PASS = {dict(SCANS)["a dataset folder"]: rf"(?i)(?:[A-Z]:\\|/)(?:(?!{_FOLDER}\\)[^\\/\r\n]++(?<![A-Z]:)\\)*+{_FOLDER}(?:[\\/]|$)"}
#: Words of which a text in lower case must hold one before a pattern is tried.
HINTS: dict[str, tuple[str, ...]] = {
    "an OAuth token": ("gho_",), "a personal access token": ("github_pat_", "ghp_"), "an API key": ("sk-",), "an environment file": (".env",), "a dataset folder": ("mvtec",),
    "a temporary render folder": ("pdfs",), "an unresolved link": ("notion",), "a user's folder": ("c:\\users\\",), "assigned secret": ("key", "secret", "token", "password"),
    "cloud access key": ("akia",), "private key": ("-----begin ",), "e-mail address": ("@",), "home folder": ("/home/", "/users/"),
}
#: Suffixes of text files; files without one count too.
TEXT_SUFFIXES = ("cfg", "css", "html", "ini", "js", "json", "md", "py", "toml", "txt", "yaml", "yml")


def tracked_files(root: str) -> list[str] | None:
    """Names below a local folder that Git tracks; None if it is no working tree, or Git isn't there."""
    try:
        done = subprocess.run(["git", "-C", re.sub("^file:/+", "/", root), "ls-files", "-z"], capture_output=True, check=False)
    except OSError:
        return None
    return [n.decode("utf-8", "replace") for n in done.stdout.split(b"\0") if n] if done.returncode == 0 else None


def text_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES) -> DataFrame:
    """(path below the root, text) of the text files of a folder; a file that isn't UTF-8 is no text. In a working tree of Git these
    are the tracked ones; elsewhere all but those in hidden folders and hidden files, of which `.gitignore` counts."""
    folder = Folder(spark, root)
    base, tracked = re.sub("^file:/+", "/", folder.full).rstrip("/") + "/", tracked_files(root)
    kind = lambda n: n.rpartition("/")[2].lstrip(".").rpartition(".")[2].lower() if "." in n.rpartition("/")[2].lstrip(".") else ""
    hidden = lambda n: any(p.startswith(".") for p in n.split("/") if p != ".gitignore")
    names = [n for n, _ in folder.files() if not hidden(n)] if tracked is None else tracked
    chosen = [n for n in names if kind(n) in ("", *suffixes) or n.endswith(".gitignore")]
    source = spark.read.format("binaryFile")
    files = source.option("recursiveFileLookup", "true").load(root)
    named = files.select(F.substring(F.regexp_replace("path", "^file:/+", "/"), len(base) + 1, 1 << 20).alias("path"), "content")
    # Spark passes over names that start with a dot or an underscore, as of settings and of packages: the driver reads these few.
    if odd := [n for n in chosen if any(p.startswith((".", "_")) for p in n.split("/")) and folder.exists(n)]:
        named = named.unionByName(spark.createDataFrame([(n, bytearray(folder.read(n))) for n in odd], "path string, content binary"))
    kept = named.join(F.broadcast(spark.createDataFrame([(n,) for n in chosen], "path string")), "path", "left_semi")
    return kept.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")


def findings(files: DataFrame, key: str, text: str = "text", scans: tuple[tuple[str, str], ...] = SCANS + MORE_SCANS, exempt: DataFrame | None = None) -> DataFrame:
    """(key, description), once for each file and description. `scans` are pairs of description and pattern; a pattern without
    hints is tried on every text. `exempt` has pairs that are allowed. A null text has no findings."""
    own = files.select(key, F.col(text).alias("body"), F.lower(text).alias("lowered"))

    def found(description: str, pattern: str) -> Column:
        held = [F.col("lowered").contains(h) for h in HINTS.get(description, ())]
        tried = F.col("body").rlike(ONE_PASS.get(pattern, pattern))
        return reduce(or_, held) & tried if held else tried

    hits = F.filter(F.array(*[F.when(found(d, p), F.lit(d)) for d, p in scans]), lambda x: x.isNotNull())
    out = own.select(key, F.explode(F.array_distinct(hits)).alias("description"))
    return out if exempt is None else out.join(exempt, [key, "description"], "left_anti")


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    return files.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def missing_headings(files: DataFrame, key: str, required: DataFrame, text: str = "text") -> DataFrame:
    """Rows (key, heading) of `required` that no line of the file is."""
    own = outside_fences(files, key, text).select(key, F.rtrim("line").alias("heading")).distinct()
    return required.join(own, [key, "heading"], "left_anti")


def html_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, link_no, target)."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("link_no", "target"))


def broken_links(files: DataFrame, key: str = "path", text: str = "text", present: DataFrame | None = None) -> DataFrame:
    """(key, target, reason) of the links of Markdown files to other files: `outside` leads out of the root, `missing` names no
    file of `present` (by default `files`), `anchor` names no heading of it. Keys are paths below the root."""
    links = markdown_links(files.where(F.lower(key).endswith(".md")), key, text).distinct().where(~F.col("target").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)"))
    decoded = lambda c: F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)
    parts = F.split(F.concat(F.regexp_replace(key, r"[^/]*$", ""), decoded(F.substring_index("target", "#", 1))), "/")

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc.at) == 0, F.struct(acc.at.alias("at"), F.lit(True).alias("out"))).otherwise(F.struct(F.slice(acc.at, 1, F.greatest(F.size(acc.at) - 1, F.lit(0))).alias("at"), acc.out.alias("out")))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.struct(F.concat(acc.at, F.array(part)).alias("at"), acc.out.alias("out")))

    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    own = F.substring_index("target", "#", 1) == ""
    ends = links.withColumn("end", F.aggregate(parts, start, step)).withColumn("file", F.when(own, F.col(key)).otherwise(F.array_join("end.at", "/")))
    ends = ends.withColumn("anchor", F.when(F.col("target").contains("#"), F.lower(decoded(F.regexp_extract("target", "#(.*)$", 1)))))
    there = (present if present is not None else files).select(F.col(key).alias("file")).distinct().withColumn("found", F.lit(True))
    known = anchors(files, key, text).withColumnsRenamed({key: "file"}).distinct().withColumn("headed", F.lit(True))
    both = ends.join(there, "file", "left").join(known, ["file", "anchor"], "left")
    why = F.when(F.col("end.out"), "outside").when(F.col("found").isNull(), "missing").when(F.col("anchor").isNotNull() & F.col("headed").isNull(), "anchor")
    return both.withColumn("reason", why).where("reason is not null").select(key, "target", "reason")


def url_map_problems(entries: DataFrame, names: list[str], prefix: str, name: str = "name", url: str = "url") -> DataFrame:
    """(name, problem) of a table of named addresses: `missing`, `unexpected`, `repeated`, `prefix`, `pending`."""
    wanted = entries.sparkSession.createDataFrame([(n, True) for n in names], f"`{name}` string, wanted boolean")
    shared = entries.groupBy(url).agg(F.count(F.lit(1)).alias("times"))
    both = entries.withColumn("given", F.lit(True)).join(F.broadcast(wanted), name, "full").join(shared, url, "left")
    rules = (
        ("missing", F.col("given").isNull()), ("unexpected", F.col("wanted").isNull()), ("repeated", F.col("times") > 1),
        ("prefix", F.col("given") & ~F.coalesce(F.col(url).startswith(prefix), F.lit(False))), ("pending", F.lower(url).contains("pending")),
    )
    return both.select(name, F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules]), lambda x: x.isNotNull())).alias("problem"))


#: What a file of evidence holds.
EVIDENCE = "sample_count int, class_count int, evaluation struct<folds:int,seed:int>, top_pipelines array<struct<pipeline:string,classifier:string,mean_accuracy:double,mean_macro_f1:double>>"


def evidence(rows: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """The columns of EVIDENCE from JSON texts; a row that lacks a field or has fewer than `least` pipelines ends the job."""
    read = rows.select(F.from_json(text, EVIDENCE, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    best = F.slice("top_pipelines", 1, least)
    whole = F.forall(best, lambda p: p.pipeline.isNotNull() & p.classifier.isNotNull() & p.mean_accuracy.isNotNull() & p.mean_macro_f1.isNotNull())
    sound = F.col("sample_count").isNotNull() & F.col("class_count").isNotNull() & F.col("evaluation.folds").isNotNull() & F.col("evaluation.seed").isNotNull() & (F.size("top_pipelines") >= least) & whole
    return read.withColumn("top_pipelines", F.when(F.coalesce(sound, F.lit(False)), best).otherwise(F.raise_error(F.lit("the evidence lacks a field or a pipeline")).cast(dict(read.dtypes)["top_pipelines"])))


def shown(value: Column) -> Column:
    """A figure as it is printed, with three decimals."""
    return F.format_string("%.3f", value)


def unbacked_rows(report: DataFrame, line: str, found: DataFrame) -> DataFrame:
    """Pipelines of `evidence` whose table row in a report lacks the classifier or one of the figures as printed."""
    top = found.select(F.inline("top_pipelines"))
    cells = table_cells(report, line).select("cells")
    told = top.join(cells, F.array_contains("cells", F.col("pipeline")) & F.array_contains("cells", F.col("classifier")))
    both = told.where(F.exists("cells", lambda c: c.contains(shown(F.col("mean_accuracy")))) & F.exists("cells", lambda c: c.contains(shown(F.col("mean_macro_f1")))))
    return top.join(both.select("pipeline"), "pipeline", "left_anti")


def missing(wanted: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """What is required or linked and isn't there."""
    return wanted.join(present, on, "left_anti")


def claims(rows: DataFrame, line: str, claim: str, disclaimer: str) -> DataFrame:
    """Lines that make a claim without its disclaimer."""
    return rows.where(F.col(line).rlike(claim) & ~F.col(line).rlike(disclaimer))


def table_cells(rows: DataFrame, line: str) -> DataFrame:
    """Cells of pipe-separated lines, trimmed."""
    bare = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    strip = lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")
    return rows.where(F.col(line).contains("|")).withColumn("cells", F.transform(F.split(bare, r"\|", -1), strip))


def mismatched(expected: DataFrame, actual: DataFrame, on: list[str], value: str) -> DataFrame:
    """Rows whose values differ or that one side lacks."""
    both = expected.withColumnRenamed(value, "expected").join(actual.withColumnRenamed(value, "actual"), on, "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))
