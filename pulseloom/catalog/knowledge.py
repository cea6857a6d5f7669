"""Intelligence objects, evidence documents, retrieval and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseloom import adapters as A
from pulseloom.catalog import query, rounded
from pulseloom.functions import embedding, rules, texts
from pulseloom.operators import cells, evaluation, knowledge, retrieval
from pulseloom.plans import attribution
from pulseloom.session import shared_folder

INTEL = """
grp AS (
  SELECT 'intrusion-set--' || c_nationkey AS group_id, (c_custkey % 2) * 1000000000000000 + c_custkey AS ord1,
         CASE WHEN c_custkey % 11 <> 0 THEN c_name ELSE 'Unknown' END AS name,
         CASE WHEN c_custkey % 5 <> 0 THEN [c_mktsegment, 'N' || (c_custkey % 4)] END AS aliases,
         repeat('desc ', (c_custkey % 200)::BIGINT) || c_name AS description,
         CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'https://groups.example/' || c_custkey END AS url
  FROM customer),
g0 AS (
  SELECT group_id, arg_min(name, ord1) AS name, arg_min(url, ord1) AS mitre_url, count(*) AS occurrences, min(ord1) AS ord1,
         arg_min(description, {'l': -length(description), 'a': ord1}) AS description,
         arg_min(coalesce(aliases, []), ord1) AS single
  FROM grp GROUP BY ALL),
al AS (
  SELECT group_id, list(alias ORDER BY first, k) AS names FROM (
    SELECT group_id, alias, min(ord1) AS first, arg_min(k, ord1) AS k FROM (
      SELECT group_id, ord1, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS k FROM grp WHERE aliases IS NOT NULL)
    GROUP BY ALL) GROUP BY ALL),
groups AS (
  SELECT g0.*, CASE WHEN occurrences = 1 THEN single ELSE coalesce(names, []) END AS aliases
  FROM g0 LEFT JOIN al USING (group_id)),
tech0 AS (
  SELECT 'attack-pattern--' || (p_partkey % 150) AS id, (p_partkey % 2) * 1000000000000000 + p_partkey AS ord1, p_name AS name,
         p_type || '  ' || p_brand AS description, p_partkey % 150 AS t FROM part),
tech AS (
  SELECT id, arg_min(name, ord1) AS name, arg_min(description, ord1) AS description,
         arg_min('T' || (t + 1000) || CASE WHEN t % 2 = 0 THEN '.001' ELSE '' END, ord1) AS technique_id,
         arg_min(t % 3 = 0, ord1) AS is_c2 FROM tech0 GROUP BY id),
soft0 AS (
  SELECT CASE WHEN s_suppkey % 40 % 2 = 0 THEN 'malware' ELSE 'tool' END AS type, s_suppkey % 40 AS x, s_name AS name,
         (s_suppkey % 2) * 1000000000000000 + s_suppkey AS ord1 FROM supplier),
soft AS (SELECT type || '--' || x AS id, arg_min(type, ord1) AS type, arg_min(name, ord1) AS name FROM soft0 GROUP BY 1),
rel0 AS (
  SELECT 'intrusion-set--' || (l_suppkey % 30) AS group_id,
         CASE WHEN l_linenumber % 2 = 1 THEN 'attack-pattern--' || (l_partkey % 160)
              ELSE CASE WHEN l_partkey % 42 % 2 = 0 THEN 'malware--' ELSE 'tool--' END || (l_partkey % 42) END AS id,
         CASE WHEN l_returnflag = 'N' THEN 'mitigates' ELSE 'uses' END AS relationship_type,
         (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS ord1,
         CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE 'used in ' || l_orderkey || ' (Citation: note 7)' END AS description
  FROM lineitem),
rel AS (
  SELECT group_id, id, relationship_type, min(ord1) AS ord1, arg_min(description, ord1) AS relationship_desc
  FROM rel0 GROUP BY ALL),
gt AS (
  SELECT r.group_id, r.ord1, t.id, t.technique_id, t.name, t.description, r.relationship_desc, t.is_c2
  FROM rel r JOIN tech t USING (id) JOIN groups g USING (group_id) WHERE relationship_type = 'uses'),
gs AS (
  SELECT r.group_id, r.ord1, s.id, s.type, s.name FROM rel r JOIN soft s USING (id) JOIN groups g USING (group_id)
  WHERE relationship_type = 'uses'),
prof AS (
  SELECT group_id, g.name, g.aliases, g.description, g.mitre_url,
         (SELECT count(*) FROM gt WHERE gt.group_id = g.group_id) AS technique_count,
         (SELECT count(*) FROM gt WHERE gt.group_id = g.group_id AND is_c2) AS c2_technique_count,
         (SELECT count(*) FROM gs WHERE gs.group_id = g.group_id) AS software_count
  FROM groups g),
docs AS (
  SELECT p.group_id || '::' || c.technique_id AS id, p.group_id, p.name, c.technique_id, c.name AS technique_name,
         technique_count, c2_technique_count, mitre_url,
         'Group: ' || p.name || chr(10) || 'Aliases: ' ||
         CASE WHEN len(p.aliases) > 0 THEN array_to_string(p.aliases, ', ') ELSE '(none)' END || chr(10) ||
         'Technique: ' || c.technique_id || ' ' || c.name || chr(10) || 'Tactic: Command and Control' || chr(10) ||
         'Evidence: ' || substr(CASE WHEN relationship_desc <> '' THEN relationship_desc ELSE c.description END, 1, 900) || chr(10) ||
         'Group description: ' || substr(p.description, 1, 700) || chr(10) || 'Associated software/tools: ' ||
         coalesce((SELECT string_agg(name, ', ' ORDER BY ord1) FROM (
            SELECT group_id, name, ord1 FROM gs QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY ord1) <= 10) s
            WHERE s.group_id = p.group_id), '(none)') AS text
  FROM prof p JOIN gt c ON c.group_id = p.group_id AND c.is_c2)"""
SEARCH = """
docv AS (
  SELECT vec_id AS doc_id, 'g' || label AS group_id, 'group ' || label AS name, embedding::DOUBLE[] AS v,
         (['T1071.001', 'T1071.004', 'T1573.002', 'T1571', 'T1095', 'T1001.003', 'T1105', 'T1102.002'])[vec_id % 8 + 1] AS technique_id
  FROM embeddings),
qv AS (
  SELECT vec_id AS query_id, list_transform(list_zip(embedding::DOUBLE[], (embedding[2:] || embedding[1:1])::DOUBLE[]),
         lambda p: p[1] * (1 - vec_id % 5 / 4.0::DOUBLE) + p[2] * (vec_id % 5 / 4.0::DOUBLE)) AS v FROM embeddings),
dist AS (
  SELECT query_id, doc_id, list_distance(q.v, d.v) * list_distance(q.v, d.v) AS distance FROM qv q, docv d),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank, 1 / (1 + distance) AS score
  FROM dist QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) <= least(40, (SELECT count(*) FROM docv))),
hd AS (SELECT h.*, group_id, name, technique_id FROM hits h JOIN docv USING (doc_id)),
c0 AS (
  SELECT query_id, group_id AS candidate, min(name) AS name, min(distance) AS distance, max(score) AS top_score,
         count(*) AS chunk_count, min(rank) AS first_rank, list(technique_id ORDER BY rank) AS techniques
  FROM hd GROUP BY query_id, group_id),
c1 AS (
  SELECT *, least(1, top_score + 0.03::DOUBLE * (least(chunk_count, 3) - 1)) AS score FROM c0),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) AS candidate_rank FROM c1
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_rank) <= 5),
known AS (
  SELECT query_id, group_id, list(technique_id ORDER BY r) AS techniques FROM (
    SELECT query_id, group_id, technique_id, min(rank) AS r FROM hd GROUP BY ALL) GROUP BY ALL),
best AS (
  SELECT query_id, max(candidate) FILTER (candidate_rank = 1) AS candidate, max(name) FILTER (candidate_rank = 1) AS top_name,
         max(score) FILTER (candidate_rank = 1) AS top1, max(score) FILTER (candidate_rank = 2) AS top2
  FROM cand GROUP BY query_id),
thr AS (
  SELECT vec_id AS query_id, (['none', 'Discovery', 'C2'])[vec_id % 3 + 1] AS label, vec_id % 110 AS beacon,
         vec_id * 7 % 1000 AS dns, vec_id * 101 % 40000 AS long, (['443', '8443', '53', '80', ''])[vec_id % 5 + 1] AS port,
         vec_id % 2 = 1 AS ja3 FROM embeddings),
det0 AS (
  SELECT t.*, top_name, top1, top2, top1 - coalesce(top2, 0) AS gap, k.techniques,
         list_sort(list_distinct(list_filter(k.techniques, lambda x:
           (beacon >= 90 AND (x LIKE 'T1071%' OR x LIKE 'T1573%')) OR (dns >= 800 AND x = 'T1071.004')
           OR (long >= 28800 AND x = 'T1571') OR (port NOT IN ('', '80', '443', '53') AND x = 'T1571')
           OR (ja3 AND x LIKE 'T1573%')))) AS found
  FROM thr t JOIN best b USING (query_id) JOIN known k ON k.query_id = t.query_id AND k.group_id = b.candidate),
det AS (
  SELECT *, CASE WHEN len(found) > 0 THEN found ELSE techniques[1:5] END AS matched,
         CASE WHEN top1 < 0.6 THEN 'insufficient_top1_similarity' WHEN top2 IS NOT NULL AND gap < 0.03 THEN 'ambiguous_top1_top2_gap'
              ELSE 'accepted' END AS decision,
         least(greatest(top1 * 100 + coalesce(least(gap * 100, 20), 0), 0), 100) AS confidence
  FROM det0),
hit AS (SELECT *, len(list_filter(matched, lambda x: regexp_matches(x, '^(T1071|T1095|T1102|T1105|T1568|T1571|T1572|T1573)'))) > 0
               AS c2_hit FROM det)"""
SQUEEZE = r"trim(regexp_replace(regexp_replace({0}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g'))"


def _intel(spark, d):
    return A.intelligence_from_tables(spark, d)


def _candidates(spark, d):
    hits = retrieval.search(A.queries_from_embeddings(spark, d), A.documents_as_kb(spark, d))
    return retrieval.group_candidates(hits)


def _details(spark, d):
    return retrieval.attribution_details(
        A.threats_from_embeddings(spark, d), retrieval.best_two(_candidates(spark, d)))


@query("set5_group_merge", f"""WITH {INTEL}
SELECT group_id, name, mitre_url, description, occurrences, array_to_string(aliases, ';') AS aliases FROM groups""")
def set5(spark, d):
    return knowledge.groups(_intel(spark, d)).drop("at").withColumn("aliases", F.array_join("aliases", ";"))


@query("set4_technique_dedup", f"WITH {INTEL} SELECT id, technique_id, name, description, is_c2 FROM tech")
def set4(spark, d):
    return knowledge.techniques(_intel(spark, d)).drop("at")


@query("set4_software_dedup", f"WITH {INTEL} SELECT id, type, name, 'tool of ' || name AS description FROM soft")
def set4_software(spark, d):
    return knowledge.software(_intel(spark, d)).drop("at")


@query("set3_relationship_dedup", f"""WITH {INTEL}
SELECT group_id AS source_ref, id AS target_ref, relationship_type, relationship_desc FROM rel""")
def set3(spark, d):
    return knowledge.relationships(_intel(spark, d)).drop("at")


@query("jn8_group_techniques", f"WITH {INTEL} SELECT group_id, id AS technique_ref, technique_id, relationship_desc FROM gt")
def jn8(spark, d):
    return knowledge.group_techniques(_intel(spark, d)).select(
        "group_id", "technique_ref", "technique_id", "relationship_desc")


@query("jn8_group_software", f"WITH {INTEL} SELECT group_id, id AS software_ref, type, name FROM gs")
def jn8_software(spark, d):
    return knowledge.group_software(_intel(spark, d)).select("group_id", "software_ref", "type", "name")


@query("flt6_c2_techniques", f"WITH {INTEL} SELECT group_id, technique_id FROM gt WHERE is_c2")
def flt6(spark, d):
    return knowledge.c2_techniques(_intel(spark, d)).select("group_id", "technique_id")


@query("agg11_profile_counts", f"""WITH {INTEL}
SELECT group_id, name, technique_count, c2_technique_count, software_count FROM prof""")
def agg11(spark, d):
    return knowledge.group_profiles(_intel(spark, d)).select(
        "group_id", "name", "technique_count", "c2_technique_count", "software_count")


@query("sc16_external_reference", f"WITH {INTEL} SELECT group_id, mitre_url FROM groups")
def sc16(spark, d):
    return knowledge.groups(_intel(spark, d)).select("group_id", "mitre_url")


@query("sc14_evidence_documents", f"""WITH {INTEL}
SELECT id, group_id, name, technique_id, technique_name, technique_count, c2_technique_count, mitre_url, text FROM docs""")
def sc14(spark, d):
    return knowledge.evidence_documents(_intel(spark, d)).drop("document_type", "aliases", "c2_techniques")


@query("sc15_labelled_value", f"""WITH {INTEL}
SELECT id, trim(regexp_extract(text, '(?m)^Group description:(.*)$', 1)) AS background,
       trim(regexp_extract(text, '(?m)^Associated software/tools:(.*)$', 1)) AS software FROM docs""")
def sc15(spark, d):
    docs = knowledge.evidence_documents(_intel(spark, d))
    return docs.select("id", texts.labelled_value(F.col("text"), "Group description").alias("background"),
                       texts.labelled_value(F.col("text"), "Associated software/tools").alias("software"))


ENTRIES = INTEL + f""",
raw AS (
  SELECT 'group_background' AS kind, description AS t FROM groups UNION ALL
  SELECT 'technique_name', name FROM gt WHERE is_c2 UNION ALL SELECT 'technique_description', description FROM gt WHERE is_c2
  UNION ALL SELECT 'relationship_evidence', relationship_desc FROM gt WHERE is_c2),
entries AS (
  SELECT sha256(t) AS source_hash, t AS source_text, min(kind) AS kind
  FROM (SELECT kind, {SQUEEZE.format('t')} AS t FROM raw) WHERE t <> '' GROUP BY ALL),
cache AS (
  SELECT DISTINCT sha256(t) AS source_hash, t AS source_text, zh FROM (
    SELECT {SQUEEZE.format("p_type || ' ' || p_brand")} AS t,
           CASE WHEN p_brand IN ('Brand#1', 'Brand#11', 'Brand#12', 'Brand#21', 'Brand#33') THEN '' ELSE '译 ' || p_brand END AS zh FROM part))"""


def _cache(spark, d):
    value = texts.squeeze(F.concat("p_type", F.lit(" "), "p_brand"))
    known = ~F.col("p_brand").isin("Brand#1", "Brand#11", "Brand#12", "Brand#21", "Brand#33")
    return A.table(spark, d, "part").select(
        texts.text_digest(value).alias("source_hash"), value.alias("source_text"),
        F.when(known, F.concat(F.lit("译 "), "p_brand")).otherwise(F.lit("")).alias("zh")).distinct()


@query("jn11_open_translations", f"""WITH {ENTRIES}
SELECT kind, source_hash, source_text FROM entries e
WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.source_hash = e.source_hash AND c.source_text = e.source_text AND zh <> '')""")
def jn11(spark, d):
    return knowledge.open_translations(knowledge.translation_entries(_intel(spark, d)), _cache(spark, d)).select(
        "kind", "source_hash", "source_text")


@query("jn10_display_translation", f"""WITH {ENTRIES}
SELECT p_partkey, zh AS shown FROM part LEFT JOIN (SELECT source_hash, zh FROM cache WHERE zh <> '') c
  ON c.source_hash = sha256({SQUEEZE.format("p_type || '   ' || p_brand")})""")
def jn10(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit("   "), "p_brand").alias("t"))
    return knowledge.with_translation(p, "t", "shown", _cache(spark, d)).select("p_partkey", "shown")


@query("set8_text_dedup", f"""
SELECT sha256(t) AS source_hash, min(lang) AS kind, length(t) AS n_chars
FROM (SELECT lang, {SQUEEZE.format('text')} AS t FROM documents) WHERE t <> '' GROUP BY t""")
def set8(spark, d):
    rows = knowledge.text_entries(A.table(spark, d, "documents"), "text", F.col("lang"))
    return rows.select("source_hash", "kind", F.length("source_text").alias("n_chars"))


@query("sc31_citation_cleanup", f"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace('a (Citation: x' || lang || ') ' || text || '  (citation:  y z) end',
  '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'), '(?i) *\\(Citation: *[^)]+\\)', '', 'g'), ' {{2,}}', ' ', 'g'))) AS cleaned
FROM documents""")
def sc31(spark, d):
    t = F.concat(F.lit("a (Citation: x"), "lang", F.lit(") "), "text", F.lit("  (citation:  y z) end"))
    return A.table(spark, d, "documents").select("doc_id", F.md5(texts.without_citations(t)).alias("cleaned"))


@query("sc34_text_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sc34(spark, d):
    return A.table(spark, d, "documents").select("doc_id", texts.text_digest(F.col("text")).alias("digest"))


@query("sc18_distance", f"""WITH {SEARCH}
SELECT query_id, round(list_distance(q.v, d.v) * list_distance(q.v, d.v), 6) AS distance,
       round(1 / (1 + list_distance(q.v, d.v) * list_distance(q.v, d.v)), 6) AS score
FROM qv q JOIN docv d ON d.doc_id = q.query_id""")
def sc18(spark, d):
    q, k = A.queries_from_embeddings(spark, d), A.documents_as_kb(spark, d)
    dist = retrieval.squared_l2(F.col("vector"), F.col("embedding"))
    return q.join(k, q["query_id"] == k["doc_id"]).select(
        "query_id", F.round(dist, 6).alias("distance"), F.round(retrieval.similarity(dist), 6).alias("score"))


@query("jn9_nearest_documents", f"WITH {SEARCH} SELECT query_id, doc_id, round(distance, 6) AS distance FROM hits")
def jn9(spark, d):
    hits = retrieval.nearest(A.queries_from_embeddings(spark, d), A.documents_as_kb(spark, d), 40)
    return rounded(hits, 6, "distance").select("query_id", "doc_id", "distance")


@query("jn9_nearest_in_parts", f"WITH {SEARCH} SELECT query_id, doc_id, round(distance, 6) AS distance FROM hits")
def jn9_parts(spark, d):
    hits = retrieval.nearest(A.queries_from_embeddings(spark, d), A.documents_as_kb(spark, d), 40,
                             broadcast_bytes=64 * 1024)
    return rounded(hits, 6, "distance").select("query_id", "doc_id", "distance")


@query("jn9_nearest_pruned", f"WITH {SEARCH} SELECT query_id, doc_id, round(distance, 6) AS distance FROM hits")
def jn9_pruned(spark, d):
    hits = cells.nearest_pruned(A.queries_from_embeddings(spark, d), A.documents_as_kb(spark, d), 40, region_bytes=256 * 1024)
    return rounded(hits, 6, "distance").select("query_id", "doc_id", "distance")


@query("jn9_index_search")
def jn9_index(spark, d):
    folder = shared_folder(spark)
    docs = A.documents_as_kb(spark, d)
    cells.write_index(docs, folder)
    queries = A.queries_from_embeddings(spark, d)
    hits = retrieval.search(queries, docs, by_group=False, index=cells.open_index(spark, folder).tuned(queries, 5))
    return rounded(hits, 6, "distance", "score").select("query_id", "rank", "doc_id", "distance", "score")


@query("snk8_vector_index", "SELECT 'g' || label AS group_id, count(*) AS documents, count(DISTINCT vec_id) AS ids, 16 AS code_bytes FROM embeddings GROUP BY label")
def snk8_index(spark, d):
    folder = shared_folder(spark)
    docs = A.documents_as_kb(spark, d)
    for _ in range(2):  # a rebuild replaces what was there
        cells.write_index(docs, folder)
    lists = cells.open_index(spark, folder).lists
    return lists.join(docs.select("doc_id", "group_id"), "doc_id").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("documents"), F.countDistinct("doc_id").alias("ids"), F.max(F.length("codes")).alias("code_bytes"))


@query("top4_ranked_hits", f"WITH {SEARCH} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM hits")
def top4(spark, d):
    hits = retrieval.search(A.queries_from_embeddings(spark, d), A.documents_as_kb(spark, d))
    return rounded(hits, 6, "score").select("query_id", "rank", "doc_id", "score")


@query("flt9_filtered_search", f"""WITH {SEARCH}
SELECT query_id, doc_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY dist.distance, doc_id) AS rank
FROM dist JOIN docv USING (doc_id) WHERE technique_id = 'T1571'
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist.distance, doc_id) <= 40""")
def flt9(spark, d):
    hits = retrieval.search(A.queries_from_embeddings(spark, d), A.documents_as_kb(spark, d),
                            where=F.col("technique_id") == "T1571")
    return rounded(hits, 6, "distance").select("query_id", "doc_id", "distance", "rank")


@query("agg10_group_candidates", f"""WITH {SEARCH}
SELECT query_id, candidate, name, round(distance, 6) AS distance, round(score, 6) AS score, chunk_count,
       array_to_string(techniques[1:5], ';') AS matched_techniques FROM cand""")
def agg10(spark, d):
    c = rounded(_candidates(spark, d), 6, "distance", "score")
    return c.select("query_id", "candidate", "name", "distance", "score", "chunk_count",
                    F.array_join("matched_techniques", ";").alias("matched_techniques"))


@query("win9_candidate_rank", f"WITH {SEARCH} SELECT query_id, candidate, candidate_rank FROM cand")
def win9(spark, d):
    return _candidates(spark, d).select("query_id", "candidate", "candidate_rank")


@query("win12_score_gap", f"""WITH {SEARCH}
SELECT query_id, round(top1, 6) AS top1, round(top2, 6) AS top2, round(top1 - coalesce(top2, 0), 6) AS score_gap FROM best""")
def win12(spark, d):
    return rounded(retrieval.best_two(_candidates(spark, d)), 6, "top1", "top2", "score_gap").select(
        "query_id", "top1", "top2", "score_gap")


@query("sc17_attribution_confidence", f"WITH {SEARCH} SELECT query_id, round(confidence, 4) AS confidence FROM det")
def sc17(spark, d):
    best = retrieval.best_two(_candidates(spark, d))
    return best.select("query_id", F.round(rules.attribution_confidence(F.col("top1"), F.col("top2")), 4).alias("confidence"))


@query("sc20_attribution_gate", f"WITH {SEARCH} SELECT query_id, decision FROM det")
def sc20(spark, d):
    best = retrieval.best_two(_candidates(spark, d))
    return best.select("query_id", rules.attribution_gate(F.col("top1"), F.col("top2")).alias("decision"))


@query("sc19_matched_techniques", f"WITH {SEARCH} SELECT query_id, array_to_string(matched, ';') AS techniques FROM det")
def sc19(spark, d):
    return _details(spark, d).select("query_id", F.array_join("matched_techniques", ";").alias("techniques"))


@query("sc21_c2_technique_hit", f"WITH {SEARCH} SELECT query_id, c2_hit AS c2_technique_hit FROM hit")
def sc21(spark, d):
    return _details(spark, d).select("query_id", "c2_technique_hit")


@query("prj13_attribution_details", f"""WITH {SEARCH}
SELECT query_id, label, top_name AS retrieved_top1, CASE WHEN decision = 'accepted' THEN top_name ELSE '' END AS primary_candidate,
       decision = 'accepted' AS attribution_accepted, decision AS attribution_decision, round(top1, 6) AS top1_score,
       round(coalesce(top2, 0), 6) AS top2_score, round(gap, 6) AS score_gap, round(confidence, 4) AS confidence FROM det""")
def prj13(spark, d):
    x = rounded(rounded(_details(spark, d), 6, "top1_score", "top2_score", "score_gap"), 4, "confidence")
    return x.select("query_id", "label", "retrieved_top1", "primary_candidate", "attribution_accepted",
                    "attribution_decision", "top1_score", "top2_score", "score_gap", "confidence")


@query("agg20_metrics_by_label", f"""WITH {SEARCH}
SELECT label, count(*) AS samples, count(*) AS retrieved_candidate_count, count(*) FILTER (decision = 'accepted') AS accepted_attribution_count,
       count(*) FILTER (c2_hit) AS c2_technique_hit_count, count(*) FILTER (confidence >= 70) AS high_confidence_count,
       1.0::DOUBLE AS retrieval_coverage, round(count(*) FILTER (decision = 'accepted') / count(*), 6) AS accepted_attribution_rate,
       round(count(*) FILTER (c2_hit) / count(*), 6) AS c2_technique_hit_rate,
       round(count(*) FILTER (confidence >= 70) / count(*), 6) AS high_confidence_rate,
       round(avg(confidence), 4) AS mean_confidence, round(avg(top1), 6) AS mean_top1_score, round(avg(gap), 6) AS mean_score_gap
FROM hit GROUP BY label""")
def agg20(spark, d):
    m = evaluation.retrieval_by_label(_details(spark, d), 70.0)
    return rounded(rounded(m, 6, "accepted_attribution_rate", "c2_technique_hit_rate", "high_confidence_rate",
                           "mean_top1_score", "mean_score_gap"), 4, "mean_confidence")


@query("agg21_attribution_summary", f"""WITH {SEARCH}
SELECT count(*) AS input_feature_count, 1.0::DOUBLE AS retrieval_coverage, count(*) FILTER (decision = 'accepted') AS accepted_attribution_count,
       round(count(*) FILTER (decision = 'accepted') / count(*), 6) AS accepted_attribution_rate, round(avg(top1), 6) AS mean_top1_score,
       round(avg(gap), 6) AS mean_score_gap, count(*) FILTER (c2_hit) AS c2_technique_hit_count,
       round(count(*) FILTER (c2_hit) / count(*), 6) AS c2_technique_hit_rate,
       round(count(*) FILTER (label = 'none' AND confidence >= 70) / count(*) FILTER (label = 'none'), 6) AS benign_high_confidence_rate
FROM hit""")
def agg21(spark, d):
    m = evaluation.attribution_summary(_details(spark, d), 70.0)
    return rounded(m, 6, "accepted_attribution_rate", "mean_top1_score", "mean_score_gap", "c2_technique_hit_rate",
                   "benign_high_confidence_rate")


@query("top7_technique_frequency", f"""WITH {SEARCH}
SELECT value, count(*) AS count FROM (SELECT unnest(matched) AS value FROM det) GROUP BY ALL ORDER BY count DESC, value LIMIT 30""")
def top7(spark, d):
    return evaluation.frequency(_details(spark, d), "matched_techniques", 30, explode=True)


@query("ev6_decision_frequency", f"""WITH {SEARCH}
SELECT decision AS value, count(*) AS count FROM det GROUP BY ALL""")
def ev6(spark, d):
    return evaluation.frequency(_details(spark, d), "attribution_decision")


@query("sc29_association_rows", f"""WITH {SEARCH},
near AS (SELECT *, techniques[1:5] AS five FROM cand WHERE candidate_rank <= 3)
SELECT query_id, candidate_rank, name, printf('%.1f%%', score * 100) AS association,
       CASE WHEN list_contains(five, 'T1071.001') AND list_contains(five, 'T1571') THEN
              CASE WHEN list_position(five, 'T1071.001') < list_position(five, 'T1571')
                   THEN '应用层协议：Web 协议、T1571' ELSE 'T1571、应用层协议：Web 协议' END
            WHEN list_contains(five, 'T1071.001') THEN '应用层协议：Web 协议'
            WHEN list_contains(five, 'T1571') THEN 'T1571'
            ELSE '当前网络证据与该组织画像存在有限通信行为相似性。' END AS matching_behaviors
FROM near""")
def sc29(spark, d):
    names = spark.sql("SELECT 'T1071.001' AS technique_id, '应用层协议：Web 协议' AS display_name")
    return retrieval.association_rows(_candidates(spark, d), names, F.array(F.lit("T1071.001"), F.lit("T1571")))


@query("set9_distinct_in_order", f"""WITH {SEARCH}
SELECT cand.query_id, candidate, array_to_string(k.techniques, ';') AS c2_techniques
FROM cand JOIN known k ON k.query_id = cand.query_id AND k.group_id = candidate""")
def set9(spark, d):
    return _candidates(spark, d).select("query_id", "candidate", F.array_join("c2_techniques", ";").alias("c2_techniques"))


@query("ud3_text_vectors", """
SELECT lang, count(*) AS documents, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9_]')) AS unit_vectors,
       count(*) FILTER (NOT regexp_matches(text, '[A-Za-z0-9_]')) AS zero_vectors FROM documents GROUP BY ALL""")
def ud3(spark, d):
    docs = embedding.embed_text(A.table(spark, d, "documents"), "text")
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return docs.withColumn("_norm", norm).groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.abs(F.col("_norm") - 1.0) < 1e-9).alias("unit_vectors"),
        F.count_if(F.col("_norm") == 0.0).alias("zero_vectors"))


@query("ud3_attributed_threats", """
SELECT count(*) AS threats, count(*) AS decided, 0::BIGINT AS accepted_below_bounds, 0::BIGINT AS refused_within_bounds, count(*) AS with_confidence
FROM embeddings""")
def ud3_attribution(spark, d):
    docs = knowledge.evidence_documents(_intel(spark, d)).withColumn("doc_id", F.xxhash64("id"))
    threats = A.threats_from_embeddings(spark, d)
    out = attribution.attribute_threats(threats, docs)
    near = (F.col("top1_score") >= 0.6) & ((F.col("top2_score") == 0) | (F.col("score_gap") >= 0.03))
    accepted, decision = F.col("attribution_accepted"), F.col("attribution_decision")
    named = decision.isin("accepted", "insufficient_top1_similarity", "ambiguous_top1_top2_gap")
    return out.agg(
        F.count(F.lit(1)).alias("threats"), F.count(F.when(named, decision)).alias("decided"),
        F.count_if(accepted & ~near).alias("accepted_below_bounds"), F.count_if(~accepted & near).alias("refused_within_bounds"),
        F.count(F.when(F.col("confidence").between(0, 100), 1)).alias("with_confidence"))


@query("jn10_candidate_translation", f"""WITH {ENTRIES},
usable AS (SELECT source_hash, min(zh) AS zh FROM cache WHERE zh <> '' GROUP BY ALL),
named AS (
  SELECT g.group_id, 'T' || p_partkey AS technique_id, p_type || ' ' || p_brand AS name, p_type AS evidence
  FROM part JOIN (SELECT 'G' || i AS group_id, i FROM range(7) t(i)) g ON p_partkey % 7 = i WHERE i <> 3),
zh AS (
  SELECT n.*, u.zh AS name_zh FROM named n LEFT JOIN usable u ON u.source_hash = sha256({SQUEEZE.format("n.name")})),
listed AS (SELECT group_id, count(*) AS techniques, count(name_zh) AS translated, max(name_zh) AS last_name FROM zh GROUP BY ALL)
SELECT 'G' || i AS group_id, u.zh AS background_zh, coalesce(techniques, 0) AS techniques, coalesce(translated, 0) AS translated, last_name
FROM range(7) t(i) LEFT JOIN listed ON listed.group_id = 'G' || i
LEFT JOIN (SELECT p_partkey % 7 AS i, min(p_type || ' ' || p_brand) AS b FROM part GROUP BY ALL) g USING (i)
LEFT JOIN usable u ON u.source_hash = sha256({SQUEEZE.format("g.b")})""")
def jn10_candidates(spark, d):
    p = A.table(spark, d, "part").withColumns({
        "i": F.col("p_partkey") % 7, "name": F.concat("p_type", F.lit(" "), "p_brand")}).withColumn(
        "group_id", F.concat(F.lit("G"), F.col("i").cast("string")))
    candidates = p.groupBy("group_id").agg(F.min("name").alias("background"))
    techniques = p.where(F.col("i") != 3).select(
        "group_id", F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("technique_id"), "name",
        F.col("p_type").alias("evidence"), F.lit(None).cast("string").alias("description"))
    out = knowledge.with_candidate_translations(candidates, techniques, _cache(spark, d))
    names = F.col("matched_techniques.name_zh")
    return out.select(
        "group_id", "background_zh", F.size("matched_techniques").cast("long").alias("techniques"),
        F.size(F.array_compact(names)).cast("long").alias("translated"), F.array_max(names).alias("last_name"))
