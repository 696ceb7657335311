"""The registered queries of this subpackage, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import scan_named
from . import mixing
from .alignment import align
from .conversation_repair import damage_report
from .exact_dedup import exact_dedup
from .language import identify
from .license_scan import license_scan
from .near_dedup import near_dedup
from .packing import pack
from .suffix_dedup import suffix_dedup
from .token_files import token_counts
from .tool_calls import TOOLS, calls_of, link
from .url_filter import filter_urls
from .vector_search import search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return wrap


@query(
    "op2_exact_dedup",
    r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(scan_named(spark, "documents", sf_dir)).drop("raw")


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(scan_named(spark, "documents", sf_dir))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(scan_named(spark, "documents", sf_dir))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(scan_named(spark, "documents", sf_dir)).drop("raw")


@query(
    "op3_near_dedup",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE [array_to_string(words[i : i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS shingles FROM w),
    n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
    e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
        WHERE 100 * same >= 75 * (na.n_shingles + nb.n_shingles - same)),
    c AS (SELECT doc_id, doc_id AS reach FROM n UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.reach = l.a)
    SELECT doc_id, n_shingles, min(reach) AS component_id, doc_id = min(reach) AS kept FROM n JOIN c USING (doc_id) GROUP BY doc_id, n_shingles
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(scan_named(spark, "documents", sf_dir)).drop("raw")


@query("op6_source_mix", mixing.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(scan_named(spark, "documents", sf_dir)).drop("raw").withColumn("chance", F.round("chance", 9))


@query("op7_url_filter")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(scan_named(spark, "pages", sf_dir))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(scan_named(spark, "documents", sf_dir))


@query("op1_permutation_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(scan_named(spark, "embeddings", sf_dir), F.col("vec_id") % 20 == 0)


@query("op8_tool_calls")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*calls_of(scan_named(spark, "conversations", sf_dir)), TOOLS)


@query(
    "op11_suffix_dedup",
    """
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
    w AS (SELECT doc_id, p, md5(substr(bytes, 2 * p + 1, 400)) AS win
        FROM (SELECT doc_id, bytes, unnest(range(0, len(bytes) // 2 - 199)) AS p FROM d WHERE len(bytes) >= 400)),
    r AS (SELECT doc_id, p FROM w SEMI JOIN (SELECT win FROM w GROUP BY win HAVING count(*) > 1) USING (win)),
    -- runs of windows that touch or overlap
    n AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
    g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM n),
    s AS (SELECT doc_id, run, min(p) AS start, max(p) + 200 AS stop FROM g GROUP BY doc_id, run),
    c AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM s),
    k AS (SELECT doc_id, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS last,
        string_agg(substr(bytes, 2 * before + 1, 2 * (start - before)), '' ORDER BY start) AS head FROM c JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, len(bytes) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(head, '') || substr(bytes, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(scan_named(spark, "documents", sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op12_conversation_repair",
    r"""
    WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    -- crc32 of the key: each byte, then eight shifts
    c AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(key, ''),
        lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda h, x: CASE WHEN x >= 0 THEN xor(h, x) ELSE xor(h >> 1, 3988292384 * (h & 1)) END)) % 20 AS kind FROM k),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
    o AS (SELECT *, left(role, 1) AS r, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM d),
    f AS (SELECT *, CASE WHEN last = '' THEN 'b' WHEN again THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
        lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o),
    ins(st, mid, n) AS (VALUES ('0', '0', 0), ('0', 'U', 1), ('0', 'H', 2), ('S', 'S', 0), ('S', 'U', 1), ('S', 'H', 2), ('U', 'U', 0), ('U', 'H', 1), ('H', 'H', 0), ('H', 'U', 1)),
    mv(mid, r, nxt) AS (VALUES ('0', 's', 'S'), ('0', 'u', 'U'), ('S', 'u', 'U'), ('H', 'u', 'U'), ('U', 'a', 'H')),
    q AS (SELECT DISTINCT fault, r FROM f),
    act AS (
      SELECT fault, r, mid, mid AS nxt, 4 AS cost, 'D' AS edit FROM q, (VALUES ('0'), ('S'), ('U'), ('H')) v(mid)
      UNION ALL SELECT fault, q.r, mid, nxt, CASE fault WHEN 't' THEN 3 ELSE 0 END, 'K' FROM q JOIN mv ON mv.r = q.r WHERE fault IN ('t', 'k')
      UNION ALL SELECT fault, q.r, mid, nxt, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R' FROM q JOIN mv ON mv.r IN ('u', 'a') WHERE fault IN ('t', 'k')),
    p AS (
      SELECT conv_id, 0::BIGINT AS i, '0' AS st, {'cost': 0, 'audit': ''} AS best FROM (SELECT DISTINCT conv_id FROM f)
      UNION ALL
      SELECT p.conv_id, p.i + 1, act.nxt, min({'cost': p.best.cost + 3 * ins.n + act.cost, 'audit': p.best.audit || repeat('I', ins.n) || act.edit})
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ins ON ins.st = p.st
        JOIN act ON act.fault = f.fault AND act.r = f.r AND act.mid = ins.mid
      GROUP BY p.conv_id, p.i, act.nxt),
    n AS (SELECT conv_id, count(*) AS n, (max(turn) - min(turn) + 1 - count(DISTINCT turn)) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
    e AS (SELECT n.conv_id, min({'cost': p.best.cost + 3 * ins.n, 'audit': p.best.audit || repeat('I', ins.n)}) AS best
      FROM n JOIN p ON p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.n JOIN ins ON ins.st = p.st WHERE ins.mid IN ('0', 'H') GROUP BY n.conv_id),
    l AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS edit, generate_subscripts(string_split(best.audit, ''), 1) AS pos FROM e WHERE best.audit <> ''),
    m AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS place FROM l),
    w AS (SELECT m.conv_id, m.pos, m.edit, m.place, f.role, f.r, f.text, max(CASE WHEN m.place = 1 AND m.edit = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS sys
      FROM m LEFT JOIN f ON m.edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i),
    t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS said
      FROM w WHERE edit <> 'D' GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
      coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
      LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_report(scan_named(spark, "conversations", sf_dir))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return align(scan_named(spark, "documents", sf_dir), groups=digest).withColumnRenamed("groups", "groups_sha256")
