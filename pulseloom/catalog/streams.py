"""Streams and files: every query writes rows of a given table to the shared folder and reads them back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from pulseloom import adapters as A
from pulseloom.catalog import query, rounded
from pulseloom.catalog.core import CONN, CONN_ROWS, DAY, PACKETS, TIE, WINDOWS
from pulseloom.catalog.evaluate import COUNTS, RATIO_COLUMNS, RATIOS, RUNS, SCORED
from pulseloom.catalog.hourly import AGG, ROWS
from pulseloom.catalog.knowledge import INTEL
from pulseloom.operators import gaps, hourly, knowledge, scoring, sequences
from pulseloom.operators.evaluation import confusion, false_negative_windows
from pulseloom.plans import beacons
from pulseloom.schemas import PACKETS as PACKET_TYPE
from pulseloom.session import shared_folder
from pulseloom.sources import captures, lines, sinks, tables
from pulseloom.streaming import alerts, arrivals
from pulseloom.streaming import connections as stream_connections
from pulseloom.streaming.hourly import hourly_aggregate_stream, hourly_stream


def _run(spark, stream, folder):
    """Run a stream over what is there, into files, and return what it wrote."""
    out = f"{folder}/out"
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer.option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Files of a time slice, and so of a micro-batch.
SLICE = 4


def _write_in_time_order(packets, path, slices=5):
    """Packets as ``slices`` groups of files that arrive one after the other, earlier packets first."""
    span = packets.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.floor((F.col("ts") - span[0]) * slices / (span[1] - span[0] + 1.0)), F.lit(slices - 1))
    for k in range(slices):
        packets.where(part == k).repartition(SLICE).write.mode("append").parquet(path)


@contextmanager
def _rocksdb(spark):
    """State in RocksDB while a stream with state of its own runs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _source(spark, df, folder):
    df.write.parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).parquet(f"{folder}/in")


@query("st1_hourly_stream", f"""WITH {ROWS},
h AS (
  SELECT src_ip, dst_ip, dst_port, protocol, service, window_start, count(*) AS connection_count,
         round(sum(duration), 4) AS total_duration, sum(octets)::BIGINT AS total_bytes, round(max(ts) - min(ts), 4) AS active_window
  FROM hr GROUP BY ALL)
SELECT * FROM h WHERE (window_start + 3600) * 1000 <= (SELECT floor(max(ts) * 1000) - 600000 FROM hr)""")
def st1(spark, d):
    folder = shared_folder(spark)
    rows = hourly.clean_rows(A.hourly_rows_from_events(spark, d))
    out = _run(spark, hourly_stream(_source(spark, rows, folder)), folder)
    return rounded(out.withColumn("active_window", F.col("last_ts") - F.col("first_ts")), 4, "total_duration",
                   "active_window").drop("first_ts", "last_ts")


@query("st1_hourly_full", f"""WITH {AGG}
SELECT {", ".join(hourly.KEYS)}, connection_count, round(total_duration, 4) AS total_duration, total_bytes, orig_pkts, resp_pkts,
       round(active_window, 4) AS active_window, round(avg_interval, 5) AS avg_interval, conn_state, history, label, source_files
FROM ag WHERE (window_start + 3600) * 1000 <= (SELECT floor(max(ts) * 1000) - 600000 FROM hr)""")
def st1_full(spark, d):
    folder = shared_folder(spark)
    rows = hourly.clean_rows(A.hourly_rows_from_events(spark, d))
    out = _run(spark, hourly_aggregate_stream(_source(spark, rows, folder)), folder)
    return rounded(rounded(out, 4, "total_duration", "active_window"), 5, "avg_interval").withColumn(
        "source_files", F.array_join("source_files", ";"))


@query("st2_connection_stream", f"""WITH {CONN_ROWS},
ends AS (SELECT user_id, key_forward, conn_start, start_time + duration AS last_time FROM crow),
closed AS (
  SELECT *, lead(conn_start) OVER (PARTITION BY user_id, key_forward ORDER BY conn_start) IS NOT NULL
            OR floor((last_time + {DAY}) * 1000) + 1 <= (SELECT floor(max(ts) * 1000) - 600000 FROM pk) AS done FROM ends)
SELECT user_id, key_forward, conn_start, round(duration, 4) AS duration, orig_packets, resp_packets, orig_bytes, resp_bytes,
       direction_confidence
FROM crow JOIN closed USING (user_id, key_forward, conn_start) WHERE done""")
def st2(spark, d):
    with _rocksdb(spark):
        folder = shared_folder(spark)
        _write_in_time_order(A.packets_from_events(spark, d), f"{folder}/in")
        packets = spark.readStream.schema(PACKET_TYPE).option("maxFilesPerTrigger", SLICE).parquet(f"{folder}/in")
        out = _run(spark, stream_connections.connection_stream(packets, idle_seconds=DAY), folder)
    return rounded(out, 4, "duration").select(
        F.substring("lo_ip", 8, 20).cast("long").alias("user_id"), "key_forward", "conn_start", "duration", "orig_packets",
        "resp_packets", "orig_bytes", "resp_bytes", "direction_confidence")


@query("st2_session_stream", f"""WITH {PACKETS},
g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > 7200, false) AS brk FROM pk),
s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g),
k AS (SELECT user_id, session, min(ts) AS start_time, max(ts) AS end_time, count(*) AS packets, sum(length)::BIGINT AS octets
      FROM s GROUP BY ALL)
SELECT user_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, packets, octets FROM k
WHERE (end_time + 7200) * 1000 <= (SELECT floor(max(ts) * 1000) - 600000 FROM pk)""")
def st2_sessions(spark, d):
    folder = shared_folder(spark)
    packets = _source(spark, A.packets_from_events(spark, d), folder)
    out = _run(spark, stream_connections.sessions(packets, idle_seconds=7200), folder)
    return rounded(out, 6, "start_time", "end_time").select(
        F.substring("lo_ip", 8, 20).cast("long").alias("user_id"), "start_time", "end_time", "packets", "octets")


@query("st3_capture_arrivals", f"""WITH {CONN_ROWS},
cg AS (
  SELECT *, greatest(0.0::DOUBLE, coalesce(start_time - lag(start_time) OVER w, 0.0::DOUBLE)) AS gap, row_number() OVER w AS i
  FROM crow WINDOW w AS (PARTITION BY user_id, key_forward ORDER BY start_time, conn_start)),
cr AS (SELECT *, avg(gap) OVER w AS m, stddev_pop(gap) OVER w AS s FROM cg
       WINDOW w AS (PARTITION BY user_id, key_forward ORDER BY start_time, conn_start ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
cp AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + avg((CASE WHEN m > 1e-9 THEN s / m ELSE 0 END)::FLOAT::DOUBLE) OVER w) AS p FROM cr
       WINDOW w AS (PARTITION BY user_id, key_forward ORDER BY start_time, conn_start ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
b AS (SELECT user_id, key_forward, max(p) AS p FROM cp WHERE i >= 10 GROUP BY ALL)
SELECT CASE WHEN key_forward THEN '10.0.0.' || user_id ELSE '192.0.2.1' END AS src,
       CASE WHEN key_forward THEN '192.0.2.1' ELSE '10.0.0.' || user_id END AS dst, round(p * 100, 1) AS confidence
FROM b WHERE p >= 0.5""")
def st3(spark, d):
    folder = shared_folder(spark)
    _write_in_time_order(A.packets_from_events(spark, d), f"{folder}/in")
    arrivals.start_arrivals(spark, f"{folder}/in", f"{folder}/out", 0.5, checkpoint=f"{folder}/checkpoint",
                            files_per_trigger=SLICE, available_now=True, idle_seconds=DAY).awaitTermination()
    return arrivals.current_alerts(spark, f"{folder}/out").select("src", "dst", "confidence")


@query("st3_alert_stream", f"""WITH {CONN_ROWS},
now AS (SELECT * FROM crow WHERE (floor(start_time) + 1) * 1000 <= (SELECT floor(max(ts) * 1000) - 600000 FROM pk)),
cg AS (
  SELECT *, greatest(0.0::DOUBLE, coalesce(start_time - lag(start_time) OVER w, 0.0::DOUBLE)) AS gap, row_number() OVER w AS i
  FROM now WINDOW w AS (PARTITION BY user_id, key_forward ORDER BY start_time, conn_start)),
cr AS (SELECT *, avg(gap) OVER w AS m, stddev_pop(gap) OVER w AS s FROM cg
       WINDOW w AS (PARTITION BY user_id, key_forward ORDER BY start_time, conn_start ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
cp AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + avg((CASE WHEN m > 1e-9 THEN s / m ELSE 0 END)::FLOAT::DOUBLE) OVER w) AS p FROM cr
       WINDOW w AS (PARTITION BY user_id, key_forward ORDER BY start_time, conn_start ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
b AS (SELECT user_id, key_forward, max(p) AS p, count(*) AS window_count, arg_min(i, (-p, i)) - 10 AS window_index FROM cp WHERE i >= 10 GROUP BY ALL)
SELECT CASE WHEN key_forward THEN '10.0.0.' || user_id ELSE '192.0.2.1' END AS src,
       CASE WHEN key_forward THEN '192.0.2.1' ELSE '10.0.0.' || user_id END AS dst, window_index, window_count, round(p, 6) AS probability
FROM b""")
def st3_alerts(spark, d):
    with _rocksdb(spark):
        folder = shared_folder(spark)
        _write_in_time_order(A.packets_from_events(spark, d), f"{folder}/in")
        packets = spark.readStream.schema(PACKET_TYPE).option("maxFilesPerTrigger", SLICE).parquet(f"{folder}/in")
        out = _run(spark, alerts.best_window_stream(packets, idle_seconds=DAY), folder)
    return rounded(alerts.latest(out), 6, "probability").select(
        F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "window_index", "window_count", "probability")


@query("snk1_feature_files", """
SELECT (['train', 'val', 'test'])[user_id % 5 % 3 + 1] AS split, 'events' AS source_file, count(*) AS n, round(sum(value), 2) AS duration
FROM events GROUP BY ALL""")
def snk1(spark, d):
    folder = shared_folder(spark)
    sinks.write_features(A.labelled_connections(spark, d), folder)
    return rounded(spark.read.parquet(folder).groupBy("split", "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration")), 2, "duration")


@query("snk3_evaluation_files", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def snk3(spark, d):
    folder = shared_folder(spark)
    docs = A.table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.array("lang", "source").alias("tags"))
    sinks.write_csv(docs, f"{folder}/csv")
    back = spark.read.option("header", True).csv(f"{folder}/csv")
    return back.where(F.col("tags").contains(";")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("n_chars").cast("long")).alias("chars"))


@query("snk3_metrics_json", f"""WITH {SCORED},
k AS (SELECT lang, {COUNTS.format(t='0.5')} FROM sl GROUP BY lang)
SELECT lang, tp, fp, fn, tn, {RATIOS} FROM k""")
def snk3_metrics(spark, d):
    folder = shared_folder(spark)
    metrics = ["tp", "fp", "fn", "tn", *RATIO_COLUMNS]
    found = confusion(A.scored_labels(spark, d), 0.5, ["lang"])
    sinks.write_metrics(found, f"{folder}/metrics", ["lang"], metrics)
    kind = ", ".join(f"{m}: {'bigint' if len(m) == 2 and m != 'f1' else 'double'}" for m in metrics)
    back = spark.read.schema(f"lang string, metrics struct<{kind}>").json(f"{folder}/metrics")
    return rounded(back.select("lang", "metrics.*"), 6, *RATIO_COLUMNS)


@query("snk5_knowledge_base_files", "SELECT 'g' || label AS group_id, count(*) AS documents FROM embeddings GROUP BY ALL")
def snk5(spark, d):
    folder = shared_folder(spark)
    docs = A.documents_as_kb(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.col("name").alias("text"), "group_id", "embedding")
    sinks.write_knowledge_base(docs, f"{folder}/kb")
    sinks.export_knowledge_base(spark.read.parquet(f"{folder}/kb"), f"{folder}/json")
    back = spark.read.schema("id string, text string, metadata struct<group_id:string>").json(f"{folder}/json")
    return back.groupBy(F.col("metadata.group_id").alias("group_id")).agg(F.count(F.lit(1)).alias("documents"))


@query("snk6_run_artifacts", """
SELECT 'run' || r AS analysis_id, o_orderstatus, count(*) AS n FROM orders, range(2) t(r) GROUP BY ALL""")
def snk6(spark, d):
    folder = shared_folder(spark)
    o = A.table(spark, d, "orders")
    for run in ("run0", "run1", "run0"):  # writing a run again replaces only that run
        sinks.write_run(o, folder, "threats", run)
    return spark.read.parquet(f"{folder}/threats").groupBy("analysis_id", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("src4_connection_csvs", "SELECT count(*) AS n, count(DISTINCT event_id) AS events, round(sum(value), 2) AS total FROM events")
def src4(spark, d):
    folder = shared_folder(spark)
    rows = A.table(spark, d, "events").select("event_id", "value")
    rows.write.option("header", True).csv(folder)
    back = tables.read_connection_csvs(spark, folder)
    return back.groupBy().agg(F.count("row_no").alias("n"), F.countDistinct("event_id").alias("events"),
                              F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


@query("src5_feature_split", """
SELECT CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM events GROUP BY ALL""")
def src5(spark, d):
    folder = shared_folder(spark)
    user = F.substring("src_ip", 2, 20).cast("long")
    rows = gaps.with_gap_features(A.feature_rows_from_events(spark, d), ["event_id"]).withColumn(
        "label", F.when(user % 3 == 0, 1).otherwise(F.lit(0)))
    rows.write.option("header", True).csv(f"{folder}/train")
    return tables.load_split(spark, folder, "train").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("src6_mixtape_json", """
SELECT count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events""")
def src6(spark, d):
    folder = shared_folder(spark)
    A.mixtape_from_events(spark, d).drop("row_no").write.json(folder)
    back = tables.read_mixtape(spark, folder)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query("src8_manifest", """
SELECT (['train', 'val', 'test'])[n_nationkey % 3 + 1] AS split, count(*) AS files FROM nation GROUP BY ALL""")
def src8(spark, d):
    folder = shared_folder(spark)
    n = F.col("n_nationkey")
    A.table(spark, d, "nation").select(
        F.col("n_name").alias("file_name"), A._item(["benign", "malicious"], n % 2).alias("label"),
        A._item(["train", "val", "test"], n % 3).alias("split"), F.lit("s").alias("source"), F.lit("x").alias("scenario"),
    ).write.option("header", True).csv(folder)
    return tables.read_manifest(spark, folder).groupBy("split").agg(F.count(F.lit(1)).alias("files"))


@query("src1_feature_file", "SELECT 'u' || user_id AS src_ip, count(*) AS n, round(sum(value), 2) AS duration FROM events GROUP BY ALL")
def src1_file(spark, d):
    folder = shared_folder(spark)
    A.connections_from_events(spark, d).select("src_ip", "dst_ip", "duration", F.col("start_time").alias("ts")).write.option(
        "header", True).csv(folder)
    return tables.read_feature_csv(spark, folder).groupBy("src_ip").agg(
        F.count("start_time").alias("n"), F.round(F.sum(F.col("duration").cast("double")), 2).alias("duration"))


@query("src1_quoted_breaks", """
WITH e AS (SELECT user_id, value, 'k' || event_id || CASE WHEN event_id % 3 = 0 THEN chr(10) || '"' || event_type || '",' || chr(10) ELSE '' END AS note FROM events)
SELECT 'u' || user_id AS src_ip, count(*) AS n, round(sum(value), 2) AS duration, sum(length(note))::BIGINT AS note_chars,
       count(*) FILTER (note LIKE '%' || chr(10) || '%') AS broken FROM e GROUP BY ALL""")
def src1_quoted(spark, d):
    folder = shared_folder(spark)
    event = F.col("event_id").cast("string")
    broken = F.concat(F.lit("k"), event, F.lit('\n"'), "dst_ip", F.lit('",\n'))
    note = F.when(F.col("event_id") % 3 == 0, broken).otherwise(F.concat(F.lit("k"), event))
    A.connections_from_events(spark, d).select("src_ip", "dst_ip", "duration", F.col("start_time").alias("ts"), note.alias("note")).write.option(
        "header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(folder)
    return tables.read_feature_csv(spark, folder).groupBy("src_ip").agg(
        F.count("start_time").alias("n"), F.round(F.sum(F.col("duration").cast("double")), 2).alias("duration"),
        F.sum(F.length("note")).alias("note_chars"), F.count(F.when(F.col("note").contains("\n"), 1)).alias("broken"))


@query("src3_log_files", """
SELECT '10.1.0.' || user_id AS orig_h, count(*) AS n, coalesce(sum(CASE WHEN event_id % 11 <> 0 THEN json_extract(props, '$.k')::BIGINT END), 0)::BIGINT AS octets
FROM events GROUP BY ALL""")
def src3_files(spark, d):
    folder = shared_folder(spark)
    rows = A.log_rows_from_events(spark, d)
    names = {v: k for k, v in lines.CONN_FIELDS.items()}
    columns = [c for c in rows.columns if c in names]
    header = "\t".join(["#fields", *[names[c] for c in columns]])
    # every written file starts with its own header line
    body = rows.select(F.concat_ws("\t", *columns).alias("value")).withColumn("part", F.spark_partition_id())
    head = body.select("part").distinct().select(F.lit(header).alias("value"), "part")
    text = head.withColumn("k", F.lit(0)).unionByName(body.withColumn("k", F.lit(1)))
    text.repartition("part").sortWithinPartitions("part", "k").select("value").write.text(folder)
    parsed = lines.parse_tsv_logs(lines.read_lines(spark, folder), lines.CONN_FIELDS)
    return parsed.groupBy("orig_h").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("orig_bytes").try_cast("long")), F.lit(0).cast("long")).alias("octets"))




@query("snk2_coverage_report", f"""WITH {CONN},
cap AS (SELECT 's__cap' || (user_id % 25) AS source_file, src_ip, dst_ip FROM conn),
sizes AS (SELECT source_file, src_ip, dst_ip, count(*) AS n FROM cap GROUP BY ALL),
cov AS (SELECT source_file, sum(n)::BIGINT AS r, count(*) AS g, count(*) FILTER (n >= 10) AS u FROM sizes GROUP BY ALL)
SELECT 'cap' || (n_nationkey * 2) AS file_name, n_name AS scenario, coalesce(r, 0) AS connection_rows,
       coalesce(g, 0) AS connection_groups, coalesce(u, 0) AS groups_with_sequence
FROM nation LEFT JOIN cov ON source_file = 's__cap' || (n_nationkey * 2)""")
def snk2(spark, d):
    folder = shared_folder(spark)
    user = F.substring("src_ip", 2, 20).cast("long")
    rows = A.connections_from_events(spark, d).withColumn(
        "source_file", F.concat(F.lit("s__cap"), (user % 25).cast("string")))
    manifest = A.table(spark, d, "nation").select(
        F.concat(F.lit("cap"), (F.col("n_nationkey") * 2).cast("string")).alias("file_name"), F.lit("benign").alias("label"),
        F.lit("train").alias("split"), F.lit("s").alias("source"), F.col("n_name").alias("scenario"))
    sinks.write_csv(sequences.coverage_report(rows, manifest), folder)
    back = spark.read.option("header", True).csv(folder)
    return back.select("file_name", "scenario", *[F.col(c).cast("long").alias(c) for c in (
        "connection_rows", "connection_groups", "groups_with_sequence")])


@query("snk7_false_negative_file", f"""WITH {WINDOWS}
SELECT src_ip, dst_ip, count(*) AS windows FROM win WHERE user_id % 3 = 0 AND probability < 0.55 GROUP BY ALL""")
def snk7(spark, d):
    folder = shared_folder(spark)
    user = F.substring("src_ip", 2, 20).cast("long")
    w = beacons.scored_windows(A.connections_from_events(spark, d), TIE).withColumn(
        "label", F.when(user % 3 == 0, 1).otherwise(F.lit(0)))
    sinks.write_csv(false_negative_windows(w, 0.55), folder)
    return spark.read.option("header", True).csv(folder).groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("windows"))


@query("snk8_knowledge_base_rebuild", f"""WITH {INTEL}
SELECT group_id, count(*) AS documents, max(length(text)) AS longest FROM docs GROUP BY ALL""")
def snk8(spark, d):
    folder = shared_folder(spark)
    docs = knowledge.evidence_documents(A.intelligence_from_tables(spark, d))
    for _ in range(2):  # a rebuild replaces what was there
        sinks.write_knowledge_base(docs, folder)
    return spark.read.parquet(folder).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("documents"), F.max(F.length("text")).alias("longest"))


@query("src7_intelligence_bundles", """
SELECT type, count(*) AS objects, count(DISTINCT id) AS ids FROM (
  SELECT 'intrusion-set' AS type, c_nationkey AS id FROM customer UNION ALL SELECT 'attack-pattern', p_partkey % 150 FROM part
  UNION ALL SELECT CASE WHEN s_suppkey % 40 % 2 = 0 THEN 'malware' ELSE 'tool' END, s_suppkey % 40 FROM supplier
  UNION ALL SELECT 'relationship', 0 FROM lineitem) GROUP BY type""")
def src7(spark, d):
    folder = shared_folder(spark)
    objects = A.intelligence_from_tables(spark, d)
    # about a thousand objects a bundle, each bundle a file of its own
    bundles = objects.withColumn("bundle", F.pmod(F.xxhash64("type", "pos"), F.lit(objects.count() // 1000 + 1))).groupBy("bundle").agg(
        F.to_json(F.struct(F.collect_list(F.struct(*[c for c in objects.columns if c not in ("file_ord", "pos")]))
                           .alias("objects"))).alias("value"))
    bundles.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    back = tables.read_bundle_folder(spark, folder)
    return back.groupBy("type").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("id").alias("ids"))


@query("src9_run_reports", f"WITH {RUNS} SELECT seed, tp, fp, fn, tn, recall FROM runs")
def src9(spark, d):
    folder = shared_folder(spark)
    s = A.scored_labels(spark, d).withColumn("seed", F.col("doc_id") % 5)
    metrics = ["threshold", "tn", "fp", "fn", "tp", "recall", "fpr", "precision", "f1"]
    reports = confusion(s, 0.5, ["seed"]).select("seed", F.to_json(F.struct(
        F.col("seed"), F.struct(*metrics).alias("validation_windows"))).alias("value"), F.col("seed").alias("run"))
    reports.select("run", "value").write.partitionBy("run").text(folder)
    back = tables.read_run_reports(spark, folder, "*.txt")
    return rounded(back.select("seed", "validation_windows.*"), 6, "recall").select("seed", "tp", "fp", "fn", "tn", "recall")


@query("src11_capture_packets", """
WITH p AS (SELECT *, epoch_us(ts) AS us, json_extract(props, '$.k')::BIGINT AS k,
                  'u' || user_id || '_' || (event_id // 1000) || '.pcap' AS source_file,
                  '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client FROM events)
SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY event_id) - 1 AS pkt_no,
       round(us // 1000000 + (us % 1000000) * 1e-6, 6) AS ts, CASE WHEN event_id % 2 = 1 THEN '192.0.2.1' ELSE client END AS src_ip,
       CASE WHEN event_id % 2 = 1 THEN client ELSE '192.0.2.1' END AS dst_ip,
       CASE WHEN event_type = 'signup' THEN 2 WHEN event_type = 'error' THEN 17 ELSE 16 END AS flags, k % 4 AS seq,
       (k + 54)::INT AS length FROM p""")
def src11(spark, d):
    packets = captures.decode_captures(A.capture_files_from_events(spark, d))
    return rounded(packets, 6, "ts").select("source_file", "pkt_no", "ts", "src_ip", "dst_ip", "flags", "seq", "length")


@query("ud1_window_arrays", f"""WITH {WINDOWS}
SELECT src_ip, dst_ip, window_index, round(probability, 6) AS probability FROM win""")
def ud1_arrays(spark, d):
    rows = gaps.with_gap_features(A.feature_rows_from_events(spark, d), TIE)
    scored = scoring.score_windows(sequences.sequence_windows(rows, TIE, features=sequences.FEATURES), scoring.regularity_blocks)
    return rounded(scored, 6, "probability").select("src_ip", "dst_ip", "window_index", "probability")
