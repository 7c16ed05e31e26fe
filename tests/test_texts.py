import json

import pytest
from pyspark.sql import functions as F

from lumenforge.operators import markdown, split
from lumenforge.operators import text_checks as tc

PAGE = """# A `Title` here

See [one](docs/a.md#part-1 "t"), [two][Ref  One] and [short], ![pic][pic], <https://x.org/a>.
Also [up](../out.md), [gone](docs/none.md), [self](#a-title-here), [no](docs/a.md#nothing), [web](https://y.org), [blank](docs/b%20c.md).

````
[not](a.md)
```
~~~~
[nor](this.md)
````
## Part
## Part ##

[ref one]: <docs/a.md>
[short]: docs/b%20c.md
[pic]: p.png
"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [("readme.md", PAGE), ("docs/a.md", "# X\n## Part\n## Part\n~~~\n# no\n~~~\n"), ("docs/b c.md", ""), ("p.png", "x"), ("n.md", None)]
    return spark.createDataFrame(rows, "path string, text string")


def test_fences(spark, files):
    assert [line for _, line in markdown.outside("a\n```x\nb\n~~~\n``\n```\nc\n   ~~~~\nd\n~~~\n~~~~~\ne\n    ```\nf")] == ["a", "c", "e", "    ```", "f"]
    lines = {(r.path, r.line) for r in tc.outside_fences(files, "path").collect()}
    assert ("readme.md", "## Part") in lines and not any("not" in x or "nor" in x for _, x in lines if "[" in x and "](" in x and "docs" not in x)


def test_links(spark, files):
    got = sorted(r.target for r in tc.markdown_links(files, "path").collect())
    assert got == sorted(["docs/a.md#part-1", "docs/a.md", "docs/b%20c.md", "p.png", "https://x.org/a", "../out.md", "docs/none.md", "#a-title-here", "docs/a.md#nothing", "https://y.org", "docs/b%20c.md"])
    anchors = {(r.path, r.anchor) for r in tc.anchors(files, "path").collect()}
    assert anchors == {("readme.md", "a-title-here"), ("readme.md", "part"), ("readme.md", "part-1"), ("docs/a.md", "x"), ("docs/a.md", "part"), ("docs/a.md", "part-1")}
    broken = {(r.target, r.reason) for r in tc.broken_links(files).collect()}
    assert broken == {("../out.md", "outside"), ("docs/none.md", "missing"), ("docs/a.md#nothing", "anchor")}


def test_scans(spark):
    texts = ["gho_" + "a" * 20, "xgho_" + "a" * 20, "ghp_" + "1" * 20 + " github_pat_" + "z" * 22, "sk-proj-" + "b" * 20, "see .env here", "a.env", ".env.local", "/data/mvtec_ad/x", "tmp/pdfs/", "Notion link: TBD", r"c:\users\ann", None, "clean"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = sorted((r.id, r.description) for r in tc.findings(docs, "id", scans=tc.SCANS).collect())
    assert got == [(0, "an OAuth token"), (2, "a personal access token"), (3, "an API key"), (4, "an environment file"), (7, "a dataset folder"), (8, "a temporary render folder"), (9, "an unresolved link"), (10, "a user's folder")]
    exempt = spark.createDataFrame([(4, "an environment file")], "id int, description string")
    assert tc.findings(docs, "id", scans=tc.SCANS, exempt=exempt).count() == 7


def test_headings_and_map(spark, files):
    wanted = spark.createDataFrame([("docs/a.md", "## Part"), ("docs/a.md", "# no"), ("docs/a.md", "# X")], "path string, heading string")
    assert [r.heading for r in tc.missing_headings(files, "path", wanted).collect()] == ["# no"]
    entries = spark.createDataFrame([("hub", "https://a/1"), ("day", "https://a/1"), ("odd", "http://b/pending"), ("none", None)], "name string, url string")
    got = sorted((r.name, r.problem) for r in tc.url_map_problems(entries, ["hub", "day", "none", "last"], "https://a/").collect())
    assert got == [("day", "repeated"), ("hub", "repeated"), ("last", "missing"), ("none", "prefix"), ("odd", "pending"), ("odd", "prefix"), ("odd", "unexpected")]


def test_evidence(spark):
    top = [{"pipeline": f"P{i}", "classifier": "knn", "mean_accuracy": 0.80368 - i / 10, "mean_macro_f1": 0.5} for i in range(4)]
    good = {"sample_count": 117, "class_count": 6, "evaluation": {"folds": 5, "seed": 42}, "top_pipelines": top}
    rows = lambda *x: spark.createDataFrame([(json.dumps(v),) for v in x], "text string")
    found = tc.evidence(rows(good))
    assert found.first().top_pipelines[0].mean_accuracy == 0.80368 and len(found.first().top_pipelines) == 3
    report = spark.createDataFrame([("| 1 | P0 | knn | 0.804 | **0.500** |",), ("| 2 | P1 | knn | 0.704 | 0.50 |",), ("| 3 | P2 | svm | 0.604 | 0.500 |",)], "line string")
    assert sorted(r.pipeline for r in tc.unbacked_rows(report, "line", found).collect()) == ["P1", "P2"]
    for bad in (good | {"sample_count": "many"}, good | {"top_pipelines": top[:2]}, {}):
        with pytest.raises(Exception, match="evidence"):
            tc.evidence(rows(bad)).collect()
    assert spark.range(1).select(tc.shown(F.lit(0.0625))).first()[0] in ("0.063", "0.062")


def test_text_files(spark, tmp_path):
    for name, data in {"a.md": b"x", "LICENSE": b"y", "b.bin": b"z", ".git/c.md": b"w", "d/e.PY": "é".encode(), "f.txt": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {(r.path, r.text) for r in tc.text_files(spark, str(tmp_path)).collect()} == {("a.md", "x"), ("LICENSE", "y"), ("d/e.PY", "é")}


def test_scans_of_long_texts_end(spark):
    """Long paths, runs and lines neither recurse nor go back."""
    long = ["/a" * 200_000, "\\a" * 200_000 + "mvtec", "C:\\" + "a\\" * 200_000 + "mvtec_ad\\x", "/" + "a" * 400_000 + "\\mvtec", "a" * 500_000 + "@", "xC:\\" * 100_000 + "mvt mvtec", "notion" + " " * 300_000]
    docs = spark.createDataFrame(list(enumerate(long)), "id int, text string")
    assert sorted((r.id, r.description) for r in tc.findings(docs, "id").collect()) == [(2, "a dataset folder"), (3, "a dataset folder")]


def test_one_pass_folders_equal_the_plain_pattern(spark):
    import random
    import re

    rng, plain = random.Random(3), dict(tc.SCANS)["a dataset folder"]
    texts = ["".join(rng.choices(["/", "\\", "C:\\", "a", "b:", "mvtec", "MVTec_AD", "mvtec-ad", "_anomaly_detection", "\n", " "], k=rng.randint(1, 9))) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id for r in tc.findings(docs, "id", scans=(("a dataset folder", plain),)).collect()}
    assert got == {i for i, t in enumerate(texts) if re.search(plain, t)} and 100 < len(got) < 3900


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("[a](b (c) 'no", []), ("[a](b(c)d)", ["b(c)d"]), ("[a](<b c> 't')", ["b c"]), ("[a](b (t))", ["b"]), (r"[a](b\)c)", [r"b\)c"]), ("[![p](i.png)](x.md)", ["i.png", "x.md"]),
        ("`[a](b)` [c](d)", ["d"]), ("``[a`](b)`` [c](d)", ["d"]), ("`[a](b)", ["b"]), (r"\[a](b) \`[c](d)`", ["d"]), ("<ftp://x> <mailto:a@b.c> <https://a b>", ["mailto:a@b.c"]), ("[a]()", [""]), ("[a [b](c) d](e)", ["c", "e"]), ("[a] (b)", []), ("[](x)", ["x"]),
    ],
)
def test_inline_links(line, want):
    assert [v for k, v in markdown.links(line) if k == "target"] == want


def test_labels_definitions_and_headings():
    assert [v for _, v in markdown.links("[a][b] [c][] [d] ![e][f] [x]: y")] == ["b", "c", "d", "f", "x"]
    assert markdown.definition("  [A  b]: <c d> 'title'") == ("A  b", "c d") and markdown.definition("[a]: b") == ("a", "b")
    assert [markdown.definition(x) for x in ("    [a]: b", "[a]:", "[]: b", "[a[b]: c", "a]: b", "[a] b")] == [None] * 6
    heads = {"# a": "a", "## a ##": "a", "#a": "", "####### a": "", "   # a #b": "a #b", "    # a": "", "# a \\#": "a \\#", "#": "", "# #": "", "# a#": "a#"}
    assert {h: markdown.heading(h) for h in heads} == heads


def test_scan_of_long_lines_is_one_pass():
    import time

    began = time.perf_counter()
    for line in ("[" * 200_000, "`" * 3 + "a`" * 100_000, "[a](" * 50_000, "]" * 200_000, "<" * 200_000 + ">", "[" * 100_000 + "]" * 100_000, "[a](b '" * 30_000, "<http://" * 30_000):
        list(markdown.links(line))
    assert time.perf_counter() - began < 10


def test_slugs(spark):
    names = {"A `Title` here": "a-title-here", "a & b": "a-b", "& b": "-b", "a &": "a-", "<b>Ü</b> x_y-z  w": "ü-x_y-z-w", "&": "", "a--b": "a--b"}
    rows = spark.createDataFrame([(k,) for k in names], "h string")
    assert {r.h: r.s for r in rows.select("h", tc.slug(F.col("h")).alias("s")).collect()} == names


def test_places_of_hot_and_null_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 5 < 4, "hot").otherwise(F.col("id").cast("string")).alias("g"), ((F.col("id") * 37) % 5000).alias("o"))
    got = split.places(rows, ["g"], ["o"], "place").collect()
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.o):
        seen[r.g] = seen.get(r.g, 0) + 1
        want[r.g, r.o] = seen[r.g]
    assert {(r.g, r.o): r.place for r in got} == want and len(got) == 5000


def test_tracked_text_files(spark, tmp_path):
    import subprocess

    for name in ("a.md", "b.md", ".gitignore", ".hidden/c.md", "d.bin", "_e.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert tc.tracked_files(str(tmp_path)) is None
    assert {r.path for r in tc.text_files(spark, str(tmp_path)).collect()} == {"a.md", "b.md", ".gitignore", "_e.py"}
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init")
    git("add", "a.md", ".gitignore", ".hidden/c.md", "d.bin", "_e.py")
    assert {r.path for r in tc.text_files(spark, str(tmp_path)).collect()} == {"a.md", ".gitignore", ".hidden/c.md", "_e.py"}
