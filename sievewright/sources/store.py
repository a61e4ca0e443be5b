"""Versioned snapshots, indexes, caches and configuration.

A snapshot is a folder of Parquet collections under ``versions/<id>``; the
newest folder under ``pointers`` names the published one.  Versions never
change: writing one again is allowed only with equal content.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import unique_violations
from ..operators.selection import upsert

UNIQUE = {"articles": ("id", "canonical_url", "content_hash"), "evidence": ("id",)}


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def fingerprint(rows: DataFrame) -> str:
    """Order-independent digest of a table's rows."""
    r = rows.select(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(20,0)").alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    return f"{r.n}:{r.h}"


def check(collections: dict[str, DataFrame]) -> None:
    """Raise if a collection repeats a value of a unique key."""
    for name, keys in UNIQUE.items():
        if name in collections:
            bad = unique_violations(collections[name], [k for k in keys if k in collections[name].columns]).limit(1).collect()
            if bad:
                raise ValueError(f"duplicate_{name}_{bad[0].key}: {bad[0].value}")


def publish(spark: SparkSession, root: str, snapshot_id: str, collections: dict[str, DataFrame]) -> None:
    """Write a version, then point at it.

    A pointer is written beside and renamed to the next number, so a reader
    finds the old one or the new one, and a failure in between loses neither.
    """
    check(collections)
    for name, rows in collections.items():
        path = f"{root}/versions/{snapshot_id}/{name}"
        if _exists(spark, path):
            if fingerprint(spark.read.parquet(path)) != fingerprint(rows):
                raise ValueError(f"version {snapshot_id} exists with other content")
        else:
            rows.write.mode("errorifexists").parquet(path)
    beside = f"{root}/pointers/.new-{uuid.uuid4().hex}"
    spark.createDataFrame([(snapshot_id,)], "snapshot_id string").coalesce(1).write.json(beside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    number = _pointers(spark, root)[-1:] or [0]
    if not files.rename(path(beside), path(f"{root}/pointers/{number[0] + 1:012d}")):
        raise OSError(f"the pointer to {snapshot_id} could not be put in place")


def _pointers(spark: SparkSession, root: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return sorted(int(f.getPath().getName()) for f in files.listStatus(path) if f.getPath().getName().isdigit())


def _version(spark: SparkSession, root: str, snapshot_id: str | None) -> str:
    """The version asked for, or the current one."""
    if snapshot_id is not None:
        return snapshot_id
    numbers = _pointers(spark, root)
    if not numbers:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.schema("snapshot_id string").json(f"{root}/pointers/{numbers[-1]:012d}").first().snapshot_id


def has(spark: SparkSession, root: str, name: str, snapshot_id: str | None = None) -> bool:
    """Has a version, the current one by default, the collection."""
    return _exists(spark, f"{root}/versions/{_version(spark, root, snapshot_id)}/{name}")


def load(spark: SparkSession, root: str, name: str, snapshot_id: str | None = None) -> DataFrame:
    """A collection of a version, the current one by default."""
    return spark.read.parquet(f"{root}/versions/{_version(spark, root, snapshot_id)}/{name}")


def camel(name: str) -> str:
    """``snake_case`` as ``snakeCase``: how records name their fields in JSON."""
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def camel_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`").alias(camel(c)) for c in rows.columns])


def snake_columns(rows: DataFrame) -> DataFrame:
    """The reverse of :func:`camel_columns`."""
    return rows.select(*[F.col(f"`{c}`").alias("".join(f"_{x.lower()}" if x.isupper() else x for x in c)) for c in rows.columns])


INDEX_SCHEMA = "1.0.0"


def build_index(chunks: DataFrame, embed, text: str = "text") -> DataFrame:
    """Chunks with their ``vector``; ``embed`` is an expression from text to array<double>."""
    return chunks.withColumn("vector", embed(F.col(text)))


def write_index(index: DataFrame, path: str, snapshot_id: str, model: str, dimensions: int, chunking: str) -> None:
    """Write an index and then its description, which commits it.

    Raises, and writes no description, if a vector has another length.
    """
    spark = index.sparkSession
    index.write.mode("errorifexists").parquet(f"{path}/records")
    found = spark.read.parquet(f"{path}/records").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("vector"), F.lit(-1)) != dimensions).alias("bad")).first()
    if found.bad:
        raise ValueError(f"{found.bad} of {found.n} vectors don't have {dimensions} dimensions")
    about = [(INDEX_SCHEMA, snapshot_id, chunking, model, dimensions, found.n)]
    spark.createDataFrame(about, "schema_version string, snapshot_id string, chunking_version string, embedding_model string, dimensions int, records long").coalesce(1).write.json(f"{path}/about")


def load_index(spark: SparkSession, path: str, model: str | None = None, dimensions: int | None = None, chunking: str | None = None) -> DataFrame:
    """An index's records; raises if it is not committed or was made otherwise than asked for."""
    about = spark.read.schema("schema_version string, chunking_version string, embedding_model string, dimensions int, records long").json(f"{path}/about").first()
    for name, want in (("schema_version", INDEX_SCHEMA), ("embedding_model", model), ("dimensions", dimensions), ("chunking_version", chunking)):
        if want is not None and about[name] != want:
            raise ValueError(f"index has {name} {about[name]}, not {want}")
    return spark.read.parquet(f"{path}/records")


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A ledger's states (ledger, last_settled_date, balance, last_model_calls), each write a new generation."""
    spark = ledger.sparkSession
    number = (_pointers(spark, path)[-1:] or [0])[0] + 1
    at = spark._jvm.org.apache.hadoop.fs.Path
    beside = f"{path}/pointers/.new-{uuid.uuid4().hex}"
    ledger.write.parquet(beside)
    if not at(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(at(beside), at(f"{path}/pointers/{number:012d}")):
        raise OSError("the ledger could not be put in place")


def load_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest generation; None where there is none."""
    numbers = _pointers(spark, path)
    return spark.read.parquet(f"{path}/pointers/{numbers[-1]:012d}") if numbers else None


def load_overlay(spark: SparkSession, path: str) -> DataFrame:
    """An editorial package: JSON lines (content_hash, title_zh, summary_zh); a repeated or empty key is an error."""
    rows = spark.read.schema("content_hash string, title_zh string, summary_zh string").json(path)
    bad = rows.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1 or content_hash is null").limit(1).collect()
    if bad:
        raise ValueError(f"editorial package repeats or lacks a content hash: {bad[0].content_hash}")
    return rows


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """A terminology file: JSON lines (source, preferred, aliases)."""
    rows = spark.read.schema("source string, preferred string, aliases array<string>").json(path)
    return rows.where("source is not null and preferred is not null").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, for a query's own files."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='sievewright-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/store/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: what they took is done once, and no later filter is pushed into it."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def to_json(rows: DataFrame) -> DataFrame:
    """One deterministic JSON text a row, fields by name."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def write_ndjson(rows: DataFrame, path: str) -> None:
    """One JSON line a row, as vector stores load them."""
    to_json(rows).write.text(path)


def vector_lines(vectors: DataFrame, metadata: list[str]) -> DataFrame:
    """Vectors (id, values) with a metadata object."""
    return vectors.select("id", "values", F.struct(*metadata).alias("metadata"))


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def append_run(rows: DataFrame, path: str) -> None:
    """Lineage of a run: one row a stage."""
    rows.write.mode("append").parquet(path)


def cache_get(rows: DataFrame, cache: DataFrame, key: str, *values: str) -> DataFrame:
    """``rows`` with the cached values of their key; null where there are none."""
    latest = cache.groupBy(key).agg(F.max_by(F.struct(*values), "stored_at").alias("_c"))
    return rows.join(latest, key, "left").select(*rows.columns, *[F.col("_c").getField(v).alias(v) for v in values])


def cache_put(rows: DataFrame, path: str) -> None:
    rows.withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(path)


def update_archive(old: DataFrame, new: DataFrame, key: str, newest: str) -> DataFrame:
    """Catalog rows by key, the new ones winning, newest first."""
    return upsert(old, new, key).orderBy(F.desc(newest), F.asc(key))


def archive_entries(rows: DataFrame) -> DataFrame:
    """Catalog rows with an id, a time and a path inside ``versions/``."""
    return rows.where(F.col("id").isNotNull() & F.col("generated_at").isNotNull() & F.col("path").rlike(r"^versions/[A-Za-z0-9._\-]+(?:\.json)?$"))


def archive_search(archive: DataFrame, shown: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Archived rows whose text has the query (two characters or more), shown ones left out."""
    q = query.strip().lower()
    if len(q) < 2:
        return archive.limit(0)
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))))
    return archive.where(F.contains(text, F.lit(q))).join(shown.select("id"), "id", "left_anti").orderBy("ord").limit(max(1, min(20, most)))


@dataclass(frozen=True)
class Source:
    """A configured source; unknown keys are an error, as everywhere in a configuration."""

    id: str
    name: str
    adapter: str
    url: str
    language: str = "en"
    region: str = ""
    enabled: bool = True
    source_type: str = "official"
    evidence_tier: str = "primary"
    max_items: int = 20
    max_selected_items: int | None = None
    max_summary_chars: int = 2500
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    title_classes: tuple[str, ...] = ()
    heading_tags: tuple[str, ...] = ("h3",)
    require_date: bool = False
    require_summary: bool = False
    extra: dict = field(default_factory=dict)


def load_config(path: str) -> list[Source]:
    """Sources from a JSON configuration, or YAML where a YAML parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    return [Source(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items()}) for row in data["sources"]]


def source_dimension(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The dimension table of configured sources; the homepage is the URL's origin."""
    rows = [(s.id, s.name, s.url, s.language, s.region, s.source_type, s.evidence_tier, s.enabled) for s in sources]
    out = spark.createDataFrame(rows, "id string, name string, url string, language string, region string, source_type string, evidence_tier string, enabled boolean")
    return with_homepage(out)


def with_homepage(sources: DataFrame) -> DataFrame:
    """Adds the origin of ``url`` as ``homepage``."""
    return sources.withColumn("homepage", F.concat(F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.lit("/")))
