"""Registered queries of this subpackage: ``opN_<name>`` over whole tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .bytebpe import encode_bytes
from .common import read
from .licenses import scan_licenses
from .lines import dedup_lines
from .mixing import ALPHA, mix, topic_of
from .neardups import near_duplicates
from .pii import KINDS, find_pii, span_text
from .quality import quality_verdicts
from .repair import damage, repair_report
from .secrets import scan_secrets
from .substrings import dedup_substrings
from .topk import exact_topk
from .whitening import by_component, whiten

#: SQL: the words of a text (runs of anything but ASCII white space)
SQL_WORDS = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"


def q_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probabilities and decisions of all documents, raked to tempered marginals."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return mix(docs, topic_of(F.col("text"))).select(
        "doc_id", "_mix.n_tokens", F.round("_mix.prob", 4).alias("prob"), "_mix.sampled")


def _sql_goal(dim: str) -> str:
    return (f"(SELECT {dim}, sum(sum(tokens)) OVER () * pow(sum(tokens), {ALPHA}) / sum(pow(sum(tokens), {ALPHA})) OVER () AS goal "
            f"FROM cells GROUP BY {dim})")


SQL_OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang,
    CAST(len({SQL_WORDS}) AS BIGINT) AS n_tokens,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
         WHEN contains(coalesce(text, ''), '%%%') OR contains(coalesce(text, ''), '###') THEN 'markup'
         WHEN regexp_matches(coalesce(text, ''), '[0-9]{{4}}') THEN 'records'
         WHEN length(text) - length(replace(text, chr(10), '')) >= 5 THEN 'article' ELSE 'prose' END AS topic FROM documents),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
goals AS (SELECT c.*, s.goal AS gs, l.goal AS gl, t.goal AS gt FROM cells c
          JOIN {_sql_goal("source")} s ON c.source IS NOT DISTINCT FROM s.source
          JOIN {_sql_goal("lang")} l ON c.lang IS NOT DISTINCT FROM l.lang
          JOIN {_sql_goal("topic")} t ON c.topic IS NOT DISTINCT FROM t.topic),
raked AS (SELECT 0 AS r, *, CAST(1 AS DOUBLE) AS f FROM goals UNION ALL
  SELECT r + 1, source, lang, topic, tokens, gs, gl, gt, CASE WHEN w > 0 THEN f * gt / w ELSE f END FROM (
    SELECT *, sum(tokens * f) OVER (PARTITION BY topic) AS w FROM (
      SELECT r, source, lang, topic, tokens, gs, gl, gt, CASE WHEN w > 0 THEN f * gl / w ELSE f END AS f FROM (
        SELECT *, sum(tokens * f) OVER (PARTITION BY lang) AS w FROM (
          SELECT r, source, lang, topic, tokens, gs, gl, gt, CASE WHEN w > 0 THEN f * gs / w ELSE f END AS f FROM (
            SELECT *, sum(tokens * f) OVER (PARTITION BY source) AS w FROM raked WHERE r < 60))))) ),
p AS (SELECT source, lang, topic, least(f / (SELECT max(f) FROM raked WHERE r = 60 AND tokens > 0), 1.0) AS prob FROM raked WHERE r = 60)
SELECT doc_id, n_tokens, round(prob, 4) AS prob,
       CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0 < prob AS sampled
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic
"""


def q_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th embedding with all others."""
    v = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_topk(v, v.filter("vec_id % 50 = 0"), 5)


SQL_OP5 = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def q_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup over all documents."""
    return dedup_substrings(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "_parse.n_words", "_parse.n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL_OP2 = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS ref_doc FROM w GROUP BY k HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM w JOIN f USING (k) WHERE doc_id > ref_doc),
all_words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
kept AS (SELECT a.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t
         FROM all_words a LEFT JOIN gone USING (doc_id, j) WHERE gone.j IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def q_op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


SQL_OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b USING (k) WHERE a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
c AS (SELECT u, min(v) AS class_id FROM reach GROUP BY u),
k AS (SELECT u, count(*) AS n_links FROM links GROUP BY u),
t AS (SELECT g, min(doc_id) AS copy_id FROM s WHERE len(g) > 0 GROUP BY g)
SELECT s.doc_id, class_id, coalesce(copy_id, s.doc_id) AS copy_id, coalesce(n_links, 0) AS n_links
FROM s JOIN c ON s.doc_id = c.u LEFT JOIN k ON s.doc_id = k.u LEFT JOIN t ON s.g = t.g
"""


def q_op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret scan of all documents: every candidate with its score."""
    return scan_secrets(read(spark, sf_dir, "documents", "doc_id", "text", "source")).select(
        "doc_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"),
        F.sha2("match", 256).alias("match_sha256"), F.round("prob", 6).alias("prob"), "is_secret", "trained")


def q_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = find_pii(read(spark, sf_dir, "documents", "doc_id", "text"))

    def count(i):
        return F.size(F.filter("base", lambda c: c["kind"] == i)).cast("long")

    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def q_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of all documents."""
    return encode(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "_bpe.n_tokens", F.sha2("_bpe.ids", 256).alias("ids_sha256"),
        F.sha2("_bpe.decoded", 256).alias("decoded_sha256"))


def q_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of all documents."""
    base, spans = F.col("_license.base"), F.col("_license.spans")

    def joined(labels):
        return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))

    return scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "_license.n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"), joined(F.concat(base["label"], spans["label"])).alias("labels"),
        F.when(F.size(base) > 0, 1.0).when(F.size(spans) > 0, F.least(F.array_max(spans["cover"]), F.lit(1.0)))
        .otherwise(0.0).alias("score"))


def q_op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents."""
    return dedup_lines(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", F.col("_lines.total").alias("n_lines"), F.col("_lines.dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


SQL_OP9 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, d.first_doc IS NOT NULL AND k.doc_id > d.first_doc AS gone FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def q_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents, thresholds from all labels."""
    return quality_verdicts(read(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                            read(spark, sf_dir, "labels", "doc_id", "quality"))


def q_op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of all embeddings."""
    return by_component(whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), 8))


def q_op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE encoding and decoding of all documents."""
    return encode_bytes(read(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "_bytes.n_tokens", F.sha2("_bytes.ids", 256).alias("ids_sha256"),
        F.sha2("_bytes.decoded", 256).alias("decoded_sha256"))


def q_op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure repair of all conversations after the stated damage."""
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return repair_report(rows, damage(rows))


def _sql_step(states: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in states.items())


def _sql_op13() -> str:
    """Forward dynamic programme: one recursive row per conversation and position; s0..s3 hold cost and audit of each
    grammar state (costs have six digits, so that text order is cost order and then ASCII order of the audits)."""
    none = "'~'"                                   # sorts behind every digit

    def plus(state, cost, edit):
        return f"CASE WHEN {state} = '~' THEN '~' ELSE printf('%06d', CAST(left({state}, 6) AS INT) + {cost}) || substr({state}, 7) || '{edit}' END"

    fill = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
    # inserted rows before the row (two are enough: a third leads back)
    once = {f"i{q}": f"least(s{q}, {', '.join(plus(f's{p}', 5, 'I') for p in fill if fill[p][0] == q) or none})" for q in range(4)}
    twice = {f"j{q}": f"least(i{q}, {', '.join(plus(f'i{p}', 5, 'I') for p in fill if fill[p][0] == q) or none})" for q in range(4)}
    after = {}
    for q in range(4):
        ways = [plus(f"j{q}", 2, "D")]
        for p in range(4):
            for role, to in ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})[p].items():
                if to == q:
                    ways.append(f"CASE WHEN must OR initial <> '{role}' THEN '~' ELSE {plus(f'j{p}', 'extra', 'K')} END")
            if fill[p][0] == q:
                ways.append(f"CASE WHEN must OR initial = '{fill[p][1]}' THEN '~' ELSE {plus(f'j{p}', '1 + extra', 'R')} END")
        after[f"s{q}"] = f"least({', '.join(ways)})"
    crc = ("[list_reduce([c] || range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FOR c IN range(256)]")
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
c AS (SELECT k.*, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(name, '')],
        lambda h, b: xor(h // 256, t.crc[CAST(xor(h, b) & 255 AS INT) + 1])), 4294967295) % 20 AS kind
      FROM k, (SELECT {crc} AS crc) t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
      NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM o),
g AS (SELECT *, blank OR again AS must, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM f),
dp AS (SELECT DISTINCT conv_id, CAST(1 AS BIGINT) AS i, '000000' AS s0, '~' AS s1, '~' AS s2, '~' AS s3 FROM g
  UNION ALL SELECT conv_id, i + 1, {_sql_step(after)} FROM (SELECT *, {_sql_step(twice)} FROM (SELECT *, {_sql_step(once)} FROM (
    SELECT dp.conv_id, dp.i, s0, s1, s2, s3, g.must, g.initial, g.extra FROM dp JOIN g ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.i = g.i)))),
last AS (SELECT conv_id, least(s0, {plus('s1', 10, 'II')}, {plus('s2', 5, 'I')}, s3) AS best FROM dp
         QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
plan AS (SELECT conv_id, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit FROM last),
e AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM plan),
e2 AS (SELECT conv_id, p, substr(audit, p, 1) AS edit, length(replace(left(audit, p), 'I', '')) AS i,
       length(replace(left(audit, p), 'D', '')) AS place FROM e),
r AS (SELECT e2.conv_id, e2.place, edit, g.role, g.text, g.initial,
      max(CASE WHEN edit = 'K' AND g.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e2.conv_id) AS system
      FROM e2 LEFT JOIN g ON e2.conv_id IS NOT DISTINCT FROM g.conv_id AND e2.i = g.i AND edit <> 'I' WHERE edit <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
             || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS sha FROM r GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
      count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT must) AS truncated,
      count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
       coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN plan ON a.conv_id IS NOT DISTINCT FROM plan.conv_id LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id
"""


SQL_OP13 = _sql_op13()

QUERIES = {
    "op1_source_mixing": q_op1,
    "op3_ngram_jaccard_join": q_op3,
    "op2_substring_dedup": q_op2,
    "op4_secret_scan": q_op4,
    "op5_exact_topk": q_op5,
    "op6_bpe_codec": q_op6,
    "op7_pii": q_op7,
    "op8_license_scan": q_op8,
    "op9_line_dedup": q_op9,
    "op10_quality_rules": q_op10,
    "op11_whitening": q_op11,
    "op12_byte_bpe": q_op12,
    "op13_conversation_repair": q_op13,
}

ORACLE = {
    "op1_source_mixing": SQL_OP1,
    "op5_exact_topk": SQL_OP5,
    "op3_ngram_jaccard_join": SQL_OP3,
    "op2_substring_dedup": SQL_OP2,
    "op9_line_dedup": SQL_OP9,
    "op13_conversation_repair": SQL_OP13,
}
