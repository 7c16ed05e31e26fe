"""One query for each operator, with production parameters, over whole tables; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, exact_dedup, html_text, jaccard_join, media, mixing, packing, piece_codec, pii, secrets, suffix_dedup, toxicity, whitening
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_scores(docs, table(spark, sf_dir, "labels"))
    score = F.col("toxic_score")
    return scored.select("doc_id", (toxicity.fold() == 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *pii.counts(pii.BASE), *pii.span_digest(found, pii.BASE), F.size("spans").cast("long").alias("n_spans"), pii.confident().alias("n_confident"), pii.scores().alias("scores"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return found.select("doc_id", *pii.counts(secrets.BASE), *pii.span_digest(found, secrets.BASE), "n_live", "n_copied", "most_owners", "most_repos")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.stored_texts(table(spark, sf_dir, "documents"))
    size = lambda c: F.octet_length(c).cast("long")
    return stored.select(
        "doc_id", "n_bytes", size("payload").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -media.WIDTH, media.WIDTH)).alias("tail_crc32"),
        size("media").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws(":", "dhash", F.sha2("npy_tile", 256)).alias("feature"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return taken.select("doc.doc_id", *mixing.LEVELS, "n_tokens", "epoch", "leaf_budget")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"), "vec_id")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pieces.*")
    told = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_pii, op3_exact_dedup, op4_packing, op5_secrets, op6_suffix_dedup, op7_html, op8_media, op9_jaccard_join, op10_mixing, op11_whitening, op12_conversation_trie, op13_sentencepiece)}


def _share_sql(nodes: str, parent: str, key: str, given: str) -> str:
    """The sharing of a budget among the nodes (room, weight, budget) of a parent."""
    return f"""
        SELECT *, CASE WHEN short THEN room ELSE (budget - sum(CASE WHEN short THEN room ELSE 0 END) OVER (PARTITION BY {parent}))
                  / sum(CASE WHEN short THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) * weight END AS {given}
        FROM (SELECT *, room <= (budget - coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY room / weight, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (PARTITION BY {parent} ORDER BY room / weight, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight AS short
              FROM ({nodes}))"""


def _mixing_sql(mix: mixing.Mix) -> str:
    weight = lambda c, w: f"CAST(CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w.items()) + f" ELSE {mix.default} END AS DOUBLE)" if w else f"CAST({mix.default} AS DOUBLE)"
    top = f"SELECT domain, sum(room) AS room, (SELECT sum(tokens) * CAST({mix.fraction} AS DOUBLE) FROM leaves) AS budget, {weight('domain', mix.domain)} AS weight FROM leaves GROUP BY domain"
    mid = f"SELECT l.domain, l.language, sum(l.room) AS room, any_value(b1) AS budget, {weight('l.language', mix.language)} AS weight FROM leaves l JOIN top USING (domain) GROUP BY l.domain, l.language"
    low = f"SELECT l.domain, l.language, l.leaf_source, l.tokens, l.room, b2 AS budget, {weight('l.leaf_source', mix.source)} AS weight FROM leaves l JOIN mid USING (domain, language)"
    return rf"""
        WITH d AS (
          SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS leaf_source, coalesce(CAST(doc_id AS VARCHAR), '') AS key,
                 CASE CAST('0x' || substr(md5(coalesce(source, '')), 1, 8) AS BIGINT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'reference' ELSE 'forum' END AS domain,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens
          FROM documents),
        leaves AS (SELECT domain, language, leaf_source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {mix.max_epochs} AS DOUBLE) AS room FROM d GROUP BY ALL),
        top AS ({_share_sql(top, "1", "domain", "b1")}),
        mid AS ({_share_sql(mid, "domain", "language", "b2")}),
        low AS ({_share_sql(low, "domain, language", "leaf_source", "b3")}),
        budgets AS (SELECT domain, language, leaf_source, CAST(floor(round(b3, 3)) AS BIGINT) AS leaf_budget,
                           CASE WHEN tokens > 0 THEN CAST(floor(round(b3, 3)) AS BIGINT) // greatest(tokens, 1) ELSE 0 END AS epochs,
                           CASE WHEN tokens > 0 THEN CAST(floor(round(b3, 3)) AS BIGINT) % greatest(tokens, 1) ELSE 0 END AS rest FROM low),
        placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, leaf_source ORDER BY md5('{mix.seed}:' || epochs || ':' || key), key) AS upto
                   FROM d JOIN budgets USING (domain, language, leaf_source)),
        copies AS (SELECT *, unnest(range(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS epoch FROM placed)
        SELECT doc_id, domain, language, leaf_source, n_tokens, CAST(epoch AS BIGINT) AS epoch, leaf_budget FROM copies"""


def _secrets_sql() -> str:
    """The parts between a pattern's matches and the matches, in turn, add up to the places."""
    quoted = {k: v.replace("'", "''") for k, v in secrets.PATTERNS.items()}
    hits = " UNION ALL ".join(f"SELECT doc_id, owner, repo, '{k}' AS kind, {i} AS rank, string_split_regex(text, '{v}') AS gaps, regexp_extract_all(text, '{v}') AS hits FROM t WHERE regexp_matches(text, '{v}')" for i, (k, v) in enumerate(quoted.items()))
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
        h AS ({hits}),
        p AS (SELECT doc_id, owner, repo, kind, rank, CAST({total("gaps[1:i]")} + {total("hits[1:i - 1]")} AS BIGINT) AS start, hits[i] AS hit FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)),
        v AS (SELECT *, start + length(hit) AS stop, CASE kind WHEN 'assign' THEN regexp_extract(hit, '{quoted["assign"]}', 2) ELSE hit END AS value FROM p),
        k AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM v WHERE kind <> 'assign' OR length(value) >= 6),
        f AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT {{'o': owner, 'r': repo}}) AS repos FROM k GROUP BY value),
        c AS (SELECT doc_id, count(*) FILTER (owners < 3) AS n_live, count(*) FILTER (owners >= 3) AS n_copied, max(owners) AS most_owners, max(repos) AS most_repos FROM (SELECT DISTINCT doc_id, value FROM k) JOIN f USING (value) GROUP BY doc_id),
        g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{x}') AS n_{x}" for x in secrets.BASE)}, string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
        SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
        FROM t LEFT JOIN g USING (doc_id) LEFT JOIN c USING (doc_id)"""


_SQL = {
    "op5_secrets": _secrets_sql(),
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
               sha256(body) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY body)""",
    "op6_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, len(h) // 2 AS n, unnest(range(0, len(h) // 2, 1000)) AS o, substr(h, 2 * unnest(range(0, len(h) // 2, 1000)) + 1, 2398) AS part FROM d),
        g AS (SELECT doc_id, o + i AS pos, md5(substr(part, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, n, o, part, unnest(range(1000)) AS i FROM b) WHERE o + i + 200 <= n),
        q AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM g) WHERE n > 1),
        i AS (SELECT *, sum(CASE WHEN pos - before <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM q)),
        s AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 200 AS z FROM i GROUP BY ALL),
        t AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM s),
        u AS (SELECT doc_id, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS kept, max(z) AS last, sum(z - a) AS n_removed, count(*) AS n_spans FROM t JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN u USING (doc_id)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a WHERE r.root < e.b),
        c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
    "op10_mixing": _mixing_sql(mixing.Mix()),
    "op12_conversation_trie": r"""
        WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, strlen(coalesce(text, '')) AS bytes, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS token
                   FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, token, bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, token) AS i FROM t),
        bits AS (SELECT c, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS b FROM (SELECT DISTINCT c FROM t)),
        z AS (SELECT c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END), 4294967295) % 9 AS h FROM bits),
        r AS (SELECT z.c, token, bytes, 0 AS part, i FROM z JOIN o ON o.c = z.c - z.c % 5 AND i <= h UNION ALL SELECT z.c, token, bytes, 1, i FROM z JOIN o ON o.c = z.c AND i > h),
        p AS (SELECT c, bytes, row_number() OVER w AS d, string_agg(token, '') OVER w AS k FROM r WINDOW w AS (PARTITION BY c ORDER BY part, i) UNION ALL SELECT c, 0, 0, '' FROM z),
        g AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY ALL),
        u AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
        f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN u USING (k)),
        s AS (SELECT top AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, left(k, 32 * unnest(range(d + 1))) AS top FROM f) GROUP BY 1),
        e AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(k, d) AS k FROM p GROUP BY c) GROUP BY k)
        SELECT f.conv_id, f.d AS depth, v.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
        FROM f JOIN s USING (k) LEFT JOIN e USING (k) LEFT JOIN f v ON f.d > 0 AND v.d = f.d - 1 AND v.k = left(f.k, 32 * (f.d - 1))""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
