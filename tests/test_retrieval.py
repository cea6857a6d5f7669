"""Exact search against brute force, roll-up and knowledge base."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.functions import embedding
from pulseloom.operators import knowledge, retrieval
from pulseloom.plans import attribution
from pulseloom.schemas import STIX_OBJECT


def vectors(spark, n, dim, seed, id_name, name):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).round(2)
    m[n // 2:n // 2 + 3] = m[0]  # exact ties
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{id_name} long, {name} array<double>")
    return m, df


@pytest.mark.parametrize("broadcast_bytes", [1 << 26, 4096])
def test_nearest_is_exact(spark, broadcast_bytes):
    q, qdf = vectors(spark, 40, 8, 1, "query_id", "vector")
    d, ddf = vectors(spark, 200, 8, 2, "doc_id", "embedding")
    got = {}
    for r in retrieval.nearest(qdf, ddf, 12, broadcast_bytes).orderBy("query_id", "distance", "doc_id").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.distance))
    for i in range(40):
        dist = ((d - q[i]) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(200), dist))[:12]
        assert [x for x, _ in got[i]] == list(order)
        assert [y for _, y in got[i]] == pytest.approx(list(dist[order]))


def test_memory_does_not_grow_with_documents():
    rng = np.random.default_rng(5)
    q, d = rng.standard_normal((256, 8)), rng.standard_normal((60_000, 8))
    ids = rng.permutation(len(d))
    tracemalloc.start()
    query, doc, distance = (np.concatenate(x) for x in zip(*retrieval._top(q, d, ids, 40)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all distances of the block take 123 MB
    for i in range(0, 256, 16):
        exact = ((d - q[i]) ** 2).sum(axis=1)
        order = np.lexsort((ids, exact))[:40]
        assert list(doc[query == i]) == list(ids[order]) and distance[query == i] == pytest.approx(exact[order])


@pytest.mark.parametrize("scale, shift", [(1e-4, 1e3), (1e18, 0.0), (1.0, 0.0)])
def test_near_vectors_of_any_size(scale, shift):
    rng = np.random.default_rng(6)
    q, d = (np.round(rng.standard_normal((n, 5)), 1) * scale + shift for n in (40, 9000))
    for i, doc, _ in retrieval._top(q, d, np.arange(len(d)), 20):
        for n in range(len(q)):
            assert list(doc[i == n]) == list(np.lexsort((np.arange(len(d)), ((d - q[n]) ** 2).sum(axis=1)))[:20])


def test_fewer_documents_than_asked(spark):
    _, qdf = vectors(spark, 8, 4, 1, "query_id", "vector")
    _, ddf = vectors(spark, 6, 4, 2, "doc_id", "embedding")
    assert retrieval.nearest(qdf, ddf, 40).count() == 48
    assert retrieval.nearest(qdf, ddf.where("doc_id < 0"), 40).count() == 0
    assert [retrieval.hit_count(5, n) for n in (1000, 30, 3)] == [40, 30, 3]


def test_roll_up(spark):
    hits = spark.createDataFrame(
        [(1, i, i + 1, s, 1 / s - 1, "g", "G", t) for i, (s, t) in enumerate([(0.5, "T1"), (0.4, "T2"), (0.3, ""), (0.2, "T1")])]
        + [(1, 9, 5, 0.1, 9.0, "", "Solo", "T3")],
        "query_id long, doc_id long, rank int, score double, distance double, group_id string, name string, technique_id string")
    first, second = retrieval.group_candidates(hits).orderBy("candidate_rank").collect()
    assert (first.candidate, first.chunk_count, first.matched_techniques, first.c2_techniques) == (
        "g", 4, ["T1", "T2", "T1"], ["T1", "T2"])
    assert first.score == pytest.approx(0.56) and first.distance == pytest.approx(1.0)
    assert (second.candidate, second.score) == ("Solo", pytest.approx(0.1))


def test_single_candidate_has_no_gap_test(spark):
    c = spark.createDataFrame([(1, "g", "G", 0.61, 1, ["T1071.001", "T1571"])],
                              "query_id long, candidate string, name string, score double, candidate_rank int, c2_techniques array<string>")
    threats = spark.createDataFrame([(1, 95.0, "8443"), (2, 0.0, "443")], "query_id long, beacon_score double, dst_port string")
    a, b = retrieval.attribution_details(threats, retrieval.best_two(c)).orderBy("query_id").collect()
    assert (a.attribution_decision, a.primary_candidate, a.matched_techniques, a.c2_technique_hit) == (
        "accepted", "G", ["T1071.001", "T1571"], True)
    assert a.confidence == pytest.approx(61) and a.score_gap == pytest.approx(0.61)
    assert (b.attribution_decision, b.primary_candidate, b.retrieved_top1, b.confidence, b.matched_techniques) == (
        "no_candidate", "", "", 0.0, [])


def objects(spark):
    ref = lambda i: [("other", "x", "y"), ("mitre-attack", i, f"https://e/{i}")]
    c2, other = [("command-and-control",)], [("discovery",)]
    rows = [
        (0, 0, ("intrusion-set", "G1", "One", ["a", "a"], "short", ref("G0001"), None, None, None, None)),
        (0, 1, ("attack-pattern", "A1", "Web", None, "web text", ref("T1071.001"), c2, None, None, None)),
        (0, 2, ("attack-pattern", "A2", "Scan", None, "scan text", ref("T1046"), other, None, None, None)),
        (0, 3, ("tool", "S1", "Hammer", None, "tool text", None, None, None, None, None)),
        (0, 4, ("relationship", "R1", None, None, "", None, None, "G1", "A1", "uses")),
        (0, 5, ("relationship", "R2", None, None, "again", None, None, "G1", "A1", "uses")),
        (0, 6, ("relationship", "R3", None, None, "scans", None, None, "G1", "A2", "uses")),
        (0, 7, ("relationship", "R4", None, None, "swings", None, None, "G1", "S1", "uses")),
        (0, 8, ("relationship", "R5", None, None, "no", None, None, "G1", "A1", "mitigates")),
        (1, 0, ("intrusion-set", "G1", "Uno", ["b", "a"], "much longer", None, None, None, None, None)),
        (1, 1, ("attack-pattern", "A1", "Other", None, "later", ref("T9"), other, None, None, None)),
        (1, 2, ("intrusion-set", "G2", "Two", ["x", "x"], None, None, None, None, None, None)),
    ]
    flat = [(f, p, *o) for f, p, o in rows]
    schema = "file_ord int, pos long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STIX_OBJECT.fields)
    return spark.createDataFrame(flat, schema)


def test_knowledge_base(spark):
    o = objects(spark)
    g = {r.group_id: r for r in knowledge.groups(o).collect()}
    assert (g["G1"].name, g["G1"].aliases, g["G1"].description, g["G1"].mitre_url) == ("One", ["a", "b"], "much longer", "https://e/G0001")
    assert (g["G2"].aliases, g["G2"].description) == (["x", "x"], "")
    p = {r.group_id: r for r in knowledge.group_profiles(o).collect()}
    assert (p["G1"].technique_count, p["G1"].c2_technique_count, p["G1"].software_count) == (2, 1, 1)
    assert p["G2"].technique_count == 0
    docs = knowledge.evidence_documents(o).collect()
    assert [d.id for d in docs] == ["G1::T1071.001"]
    assert docs[0].text == ("Group: One\nAliases: a, b\nTechnique: T1071.001 Web\nTactic: Command and Control\n"
                            "Evidence: web text\nGroup description: much longer\nAssociated software/tools: Hammer")
    kinds = {(r.kind, r.source_text) for r in knowledge.translation_entries(o).collect()}
    assert kinds == {("group_background", "much longer"), ("technique_name", "Web"), ("technique_description", "web text")}


def test_attribution_end_to_end(spark):
    docs = knowledge.evidence_documents(objects(spark)).withColumn("doc_id", F.xxhash64("id"))
    threats = spark.createDataFrame([(7, 95.0, "443", "tcp")], "query_id long, beacon_score double, dst_port string, protocol string")
    row = attribution.attribute_threats(threats, docs).first()
    assert row.retrieved_top1 == "One" and row.matched_techniques == ["T1071.001"] and row.query.startswith("使用以下特征")


def test_text_vectors_are_scaled_once_per_text(spark, capsys):
    texts = spark.createDataFrame([(1, "a b b"), (2, "!?"), (3, None)], "i int, t string")
    out = embedding.embed_text(texts, "t")
    out.select("embedding").explain()
    assert "lambda" not in capsys.readouterr().out  # the norm stood in the lambda and was taken again for every component
    own = {r.i: sorted(x for x in r.embedding if x) for r in out.collect()}
    assert own[1] == pytest.approx([1 / 5 ** 0.5, 2 / 5 ** 0.5]) and own[2] == own[3] == []
    assert out.columns == ["i", "t", "embedding"] and len(out.first().embedding) == 256
