"""Threat-intelligence objects to group profiles and evidence documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions import texts

POSITION = ["file_ord", "pos"]
_AT = F.struct


def external_reference(field: str) -> Column:
    """A field of the first catalogue reference of an object; blank if there is none."""
    refs = F.filter(
        F.coalesce(F.col("external_references"), F.array()), lambda r: r["source_name"] == "mitre-attack")
    return F.coalesce(F.get(refs, F.lit(0))[field], F.lit(""))


def _first_per_key(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    pick = F.min_by(F.struct(*[c.alias(n) for n, c in columns.items()]), _AT(*POSITION))
    return df.groupBy(*keys).agg(pick.alias("_row"), F.min(_AT(*POSITION)).alias("at")).select(*keys, "_row.*", "at")


def groups(objects: DataFrame) -> DataFrame:
    """One row per group: first name and references, all aliases, longest description.

    Aliases of a single occurrence stay as they are; those of several are made distinct before
    they are listed.
    """
    g = objects.where(F.col("type") == "intrusion-set")
    description = F.coalesce("description", F.lit(""))
    longest = _AT(F.length(description).alias("l"), (-F.col("file_ord")).alias("f"), (-F.col("pos")).alias("p"))
    merged = g.groupBy("id").agg(
        F.min_by(F.coalesce("name", F.lit("Unknown")), _AT(*POSITION)).alias("name"),
        F.min_by(external_reference("url"), _AT(*POSITION)).alias("mitre_url"),
        F.max_by(description, longest).alias("description"),
        F.count(F.lit(1)).alias("occurrences"),
        F.min_by(F.coalesce("aliases", F.array().cast("array<string>")), _AT(*POSITION)).alias("_single"),
        F.min(_AT(*POSITION)).alias("at"),
    )
    named = g.select("id", *POSITION, F.posexplode("aliases").alias("k", "alias")).groupBy("id", "alias").agg(
        F.min(_AT(*POSITION, "k")).alias("at"))
    listed = named.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(_AT("at", "alias"))), lambda a: a["alias"]).alias("_all"))
    return merged.join(listed, "id", "left").select(
        F.col("id").alias("group_id"), "name", "mitre_url", "description", "occurrences", "at",
        F.when(F.col("occurrences") == 1, F.col("_single"))
        .otherwise(F.coalesce("_all", F.array().cast("array<string>"))).alias("aliases"),
    )


def techniques(objects: DataFrame) -> DataFrame:
    """First occurrence of every technique."""
    t = objects.where(F.col("type") == "attack-pattern")
    phases = F.coalesce("kill_chain_phases", F.array())
    return _first_per_key(t, ["id"], {
        "technique_id": external_reference("external_id"),
        "name": F.coalesce("name", F.lit("Unknown")),
        "description": F.coalesce("description", F.lit("")),
        "is_c2": F.coalesce(
            F.exists(phases, lambda p: p["phase_name"] == "command-and-control"), F.lit(False)),
    })


def software(objects: DataFrame) -> DataFrame:
    """First occurrence of every malware or tool."""
    s = objects.where(F.col("type").isin("malware", "tool"))
    return _first_per_key(s, ["id"], {
        "type": F.col("type"),
        "name": F.coalesce("name", F.lit("Unknown")),
        "description": F.coalesce("description", F.lit("")),
    })


def relationships(objects: DataFrame) -> DataFrame:
    """First occurrence per (source, target, type)."""
    blank = F.lit("")
    r = objects.where(F.col("type") == "relationship").withColumns(
        {c: F.coalesce(c, blank) for c in ("source_ref", "target_ref", "relationship_type")})
    return _first_per_key(r, ["source_ref", "target_ref", "relationship_type"], {
        "relationship_desc": F.coalesce("description", blank)})


def _uses(objects: DataFrame) -> DataFrame:
    return relationships(objects).where(F.col("relationship_type") == "uses").select(
        F.col("source_ref").alias("group_id"), F.col("target_ref").alias("id"), "relationship_desc",
        F.col("at").alias("used_at"))


def _group_ids(objects: DataFrame) -> DataFrame:
    return objects.where(F.col("type") == "intrusion-set").select(F.col("id").alias("group_id")).distinct()


def group_techniques(objects: DataFrame) -> DataFrame:
    """One row per (group, technique) edge."""
    g = _group_ids(objects)
    return _uses(objects).join(g, "group_id", "left_semi").join(techniques(objects), "id").select(
        "group_id", "used_at", F.col("id").alias("technique_ref"), "technique_id", "name", "description",
        "relationship_desc", "is_c2")


def group_software(objects: DataFrame) -> DataFrame:
    """One row per (group, software) edge."""
    g = _group_ids(objects)
    return _uses(objects).join(g, "group_id", "left_semi").join(software(objects), "id").select(
        "group_id", "used_at", F.col("id").alias("software_ref"), "type", "name", "description", "relationship_desc")


def c2_techniques(objects: DataFrame) -> DataFrame:
    return group_techniques(objects).where("is_c2")


def group_profiles(objects: DataFrame) -> DataFrame:
    """Counts per group; groups without edges keep 0."""
    zero = F.lit(0).cast("long")
    t = group_techniques(objects).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("technique_count"), F.count_if("is_c2").alias("c2_technique_count"))
    s = group_software(objects).groupBy("group_id").agg(F.count(F.lit(1)).alias("software_count"))
    return groups(objects).join(t, "group_id", "left").join(s, "group_id", "left").select(
        "group_id", "name", "aliases", "description", "mitre_url",
        *[F.coalesce(c, zero).alias(c) for c in ("technique_count", "c2_technique_count", "software_count")])


def first_software(objects: DataFrame, n: int = 10) -> DataFrame:
    """Names of the first software per group; the limit is part of the document format."""
    w = Window.partitionBy("group_id").orderBy("used_at")
    top = group_software(objects).select("group_id", "used_at", "name").withColumn(
        "_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return top.groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(_AT("_n", "name"))), lambda x: x["name"]).alias("software"))


def evidence_documents(objects: DataFrame) -> DataFrame:
    """One document per (group, C2 technique): id, text, metadata columns."""
    edges = group_techniques(objects).withColumn(
        "technique_id", F.when(F.col("is_c2"), F.coalesce(F.nullif("technique_id", F.lit("")), F.lit("unknown"))))
    per_group = edges.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("technique_count"), F.count_if("is_c2").alias("c2_technique_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("is_c2"), _AT("used_at", "technique_id")))),
                    lambda x: x["technique_id"]).alias("c2_techniques"))
    none = F.array().cast("array<string>")
    joined = (
        edges.where("is_c2")
        .select("group_id", "technique_id", F.col("name").alias("technique_name"),
                F.col("description").alias("_technique_text"), "relationship_desc")
        .join(groups(objects), "group_id").join(per_group, "group_id")
        .join(first_software(objects), "group_id", "left")
    )
    aliases = F.when(F.size("aliases") > 0, F.col("aliases")).otherwise(F.array(F.lit(texts.NO_ITEMS)))
    text = texts.evidence_text(
        F.col("name"), F.col("aliases"), F.col("technique_id"), F.col("technique_name"), F.col("relationship_desc"),
        F.col("_technique_text"), F.col("description"), F.coalesce("software", none))
    return joined.select(
        F.concat("group_id", F.lit("::"), "technique_id").alias("id"),
        text.alias("text"),
        F.lit("group_technique_evidence").alias("document_type"),
        "group_id", "name", aliases.alias("aliases"), "mitre_url", "technique_id", "technique_name",
        "technique_count", "c2_technique_count", "c2_techniques",
    )


def text_entries(rows: DataFrame, text: str, kind: Column) -> DataFrame:
    """Distinct non-blank texts with their digest."""
    value = texts.squeeze(F.col(text))
    return (
        rows.select(kind.alias("kind"), value.alias("source_text")).where(F.col("source_text") != "")
        .withColumn("source_hash", texts.text_digest(F.col("source_text")))
        .groupBy("source_hash", "source_text").agg(F.min("kind").alias("kind"))
    )


def translation_entries(objects: DataFrame) -> DataFrame:
    """The texts that need a translation: group backgrounds and three texts per C2 technique."""
    c2 = c2_techniques(objects).select(F.explode(F.array(*[
        _AT(F.lit(kind).alias("kind"), F.col(c).alias("text")) for c, kind in (
            ("name", "technique_name"), ("description", "technique_description"),
            ("relationship_desc", "relationship_evidence"))
    ])).alias("e")).select("e.kind", "e.text")
    background = groups(objects).select(F.lit("group_background").alias("kind"), F.col("description").alias("text"))
    return text_entries(background.unionByName(c2), "text", F.col("kind"))


def open_translations(entries: DataFrame, cache: DataFrame) -> DataFrame:
    """Entries without a usable cached translation (same digest, same text, non-blank)."""
    usable = cache.where(F.coalesce(F.col("zh"), F.lit("")) != "").select("source_hash", "source_text")
    return entries.join(usable, ["source_hash", "source_text"], "left_anti")


def with_translation(rows: DataFrame, text: str, target: str, cache: DataFrame) -> DataFrame:
    """Add the cached translation of a text column; absent ones stay null.

    Digest and text have to match; of several translations of a text the alphabetically first is taken.
    """
    value = texts.squeeze(F.col(text))
    keyed = rows.withColumns({"_h": texts.text_digest(value), "_t": value})
    usable = cache.where(F.coalesce(F.col("zh"), F.lit("")) != "").groupBy(
        F.col("source_hash").alias("_h"), F.col("source_text").alias("_t")).agg(F.min("zh").alias(target))
    return keyed.join(usable, ["_h", "_t"], "left").drop("_h", "_t")


def with_candidate_translations(candidates: DataFrame, techniques: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates (``group_id``, ``background``) with ``background_zh`` and ``matched_techniques``, the translated techniques.

    ``techniques`` has one row per matched technique of a candidate: ``group_id``, ``technique_id``, ``name``, ``evidence`` and
    ``description``.  They are listed by id, each with ``name_zh``, ``evidence_zh`` and ``description_zh`` (null where the cache
    has none).  A candidate without techniques gets an empty list.
    """
    named = techniques
    for column in ("name", "evidence", "description"):
        named = with_translation(named, column, f"{column}_zh", cache)
    fields = ["technique_id", "name", "name_zh", "evidence", "evidence_zh", "description", "description_zh"]
    listed = named.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("matched_techniques"))
    out = with_translation(candidates, "background", "background_zh", cache).join(listed, "group_id", "left")
    empty = F.array().cast(listed.schema["matched_techniques"].dataType)
    return out.withColumn("matched_techniques", F.coalesce("matched_techniques", empty))
