"""Registered queries of the operators in this folder, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm import bpe, centroids, chat, langid, lattice, leaks, licenses, quality, ranked, repeats, simhash, token_counts, urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LICENSE_PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
LICENSE_TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
]
TOKEN_LIMIT = 1024


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])))


_URL_PARTS = """
parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages)"""


@query("op4_url_rules", f"""
WITH rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
  ('org', '/fr/', 'allow')), {_URL_PARTS},
fits AS (
  SELECT p.*, r.rhost, r.rpath, r.verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC NULLS LAST) AS n
  FROM parts p LEFT JOIN rules r ON (p.host = rhost OR suffix(p.host, '.' || rhost)) AND prefix(p.path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1""")
def op4_url_rules(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), literal_rows(spark, ["host", "path", "verdict"], URL_RULES))


@query("op1_benchmark_leaks")
def op1_benchmark_leaks(spark, sf_dir):
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_repeated_passages")
def op2_repeated_passages(spark, sf_dir):
    found = repeats.cut_repeats(table(spark, sf_dir, "documents"), 200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_simhash_groups")
def op3_simhash_groups(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"), 3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark, sf_dir):
    return bpe.round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=TOKEN_LIMIT)


_NOTICES = ", ".join(
    f"({i}, '{t}', '{label}', {exact})" for i, (t, label, exact) in enumerate(
        [*[(t, label, "true") for t, label in LICENSE_PHRASES], *[(t, label, "false") for t, label in LICENSE_TEMPLATES]]))


@query("op7_license_scan", rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
notices(template, t, label, exact) AS (VALUES {_NOTICES}),
split AS (SELECT *, string_split(t, ' ') AS tw FROM notices),
tg AS (SELECT template, label, exact, len(tw) AS t_words, len(tw) - 2 AS t_grams, unnest(range(0, len(tw) - 2)) AS t_at, tw FROM split),
tgram AS (SELECT * EXCLUDE (tw), array_to_string(tw[t_at + 1:t_at + 3], ' ') AS gram FROM tg),
dg AS (SELECT doc_id, unnest(range(0, len(w) - 2)) AS pos, w FROM docs WHERE len(w) >= 3),
hits AS (
  SELECT doc_id, pos, template, label, exact, t_words, t_grams, t_at, pos - t_at AS diagonal
  FROM (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 3], ' ') AS gram FROM dg) JOIN tgram USING (gram)),
voted AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, template, diagonal) AS votes,
         diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, t_at) AS gap FROM hits),
spanned AS (
  SELECT *, sum(CASE WHEN gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal, t_at ROWS UNBOUNDED PRECEDING) AS span,
         CASE WHEN exact AND votes = t_grams AND t_at = 0 THEN diagonal END AS place FROM voted),
spans AS (
  SELECT doc_id, template, label, exact, t_words, min(pos) AS b, max(pos) + 3 - min(pos) AS n, count(DISTINCT t_at) AS held, count(place) AS places,
         min(place) AS first, max(place) AS last, count(DISTINCT t_at) / t_grams AS share
  FROM spanned GROUP BY doc_id, template, label, exact, t_words, t_grams, span),
good AS (SELECT * FROM spans WHERE NOT exact AND share >= 0.7 AND n <= ceil(t_words * 1.5)),
apart AS (
  SELECT *, coalesce(b >= max(b + n) OVER (PARTITION BY doc_id ORDER BY b, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh
  FROM good),
passages AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY b, template ROWS UNBOUNDED PRECEDING) AS passage FROM apart),
best AS (SELECT * FROM passages QUALIFY dense_rank() OVER (PARTITION BY doc_id, passage ORDER BY share DESC, held DESC) = 1),
labelled AS (
  SELECT doc_id, label, true AS base, 1.0::DOUBLE AS score, places, first, last FROM spans WHERE exact AND places > 0
  UNION ALL SELECT doc_id, label, false, share, 0, NULL, NULL FROM best)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(sum(places), 0)::BIGINT AS n_base, min(first) AS first_word, max(last) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0::DOUBLE) AS score
FROM docs d LEFT JOIN labelled l ON l.doc_id = d.doc_id GROUP BY d.doc_id, d.w""")
def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"), LICENSE_PHRASES, LICENSE_TEMPLATES)


def _escaped(text: str) -> str:
    out = f"replace({text}, '{_CHAT.escape}', '{2 * _CHAT.escape}')"
    for control in _CHAT.controls:
        out = f"replace({out}, '{control}', '{control[0]}{_CHAT.escape}{control[1:]}')"
    return out


_CHAT = chat.Template()
_MOVES = ", ".join(f"('{a}', '{b}')" for a, follow in _CHAT.moves.items() for b in follow)


@query("op8_chat_format", f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) v(c, n, r, t)),
moves(a, b) AS (VALUES {_MOVES}),
placed AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '{chat.START}') AS before FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({sum(map(len, _CHAT.controls))} + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars,
       bool_and((before, role) IN (SELECT (a, b) FROM moves)) AS valid
FROM placed GROUP BY conv_id""")
def op8_chat_format(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    added = literal_rows(spark, given.columns, [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)])
    return chat.digests(chat.format_turns(given.unionByName(added.select(*[F.col(f.name).cast(f.dataType) for f in given.schema]))))


def held_out(doc_id) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    profiles = langid.learn(documents.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    return langid.predict(documents, profiles).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op10_lattice_links", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, list_aggregate(list_transform(embedding::DOUBLE[], lambda x: x * x), 'sum') AS n FROM embeddings),
good AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(n)) AS u FROM v WHERE n > 0 AND isfinite(n) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
component AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN component c ON c.x = vec_id LEFT JOIN degree d ON d.x = vec_id""")
def op10_lattice_links(spark, sf_dir):
    found = lattice.near_links(table(spark, sf_dir, "embeddings"), cosine=0.95)
    return found.select(
        "vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


_ROUND = """
r{n}(cluster, d, x) AS (
  WITH near AS ({near})
  SELECT o.cluster, o.d, coalesce(m.x, o.x) FROM {old} o LEFT JOIN (
    SELECT cluster, d, ((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM near JOIN v USING (n) GROUP BY cluster, d) m USING (cluster, d))"""
_NEAR = """
  SELECT n, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT n, cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN {old} c USING (d) GROUP BY n, cluster) GROUP BY n"""


@query("op12_centroids", f"""
WITH good AS (
  SELECT row_number() OVER () AS n, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT n, unnest(range(1, 65)) AS d, unnest(list_transform(e, lambda x: floor(256 * x)::BIGINT)) AS x FROM good),
start AS (SELECT n, row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS cluster FROM good QUALIFY cluster < 40),
r0 AS (SELECT cluster, d, x FROM start JOIN v USING (n)),
{",".join(_ROUND.format(n=n, near=_NEAR.format(old=f"r{n - 1}"), old=f"r{n - 1}") for n in range(1, 6))},
near AS ({_NEAR.format(old="r5")}),
digest AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM r5 GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM near JOIN good USING (n) JOIN digest USING (cluster)""")
def op12_centroids(spark, sf_dir):
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op13_ranked_search", f"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM d),
qt AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(terms) AS term FROM q) GROUP BY ALL),
dt AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM dt, total GROUP BY term, n),
m AS (SELECT d, 100 - 25 + (25 * len(terms)::BIGINT * n) // l AS m FROM d, total WHERE len(terms) > 0),
scored AS (
  SELECT q, d, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM qt JOIN dt USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY q, d),
best AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank
  FROM scored JOIN d USING (d) JOIN q USING (q) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 20""")
def op13_ranked_search(spark, sf_dir):
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_quality_rules")
def op11_quality_rules(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality.judge(documents, quality.learn(documents, table(spark, sf_dir, "labels")))
