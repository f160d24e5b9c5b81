"""Reading and writing of the declared tables, views, manifests, failures and provenance."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litmill.schemas import ENRICHMENT, conform, empty
from litmill.session import written


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table or glob, columns of its files united by name."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return bool(found)


def read_optional(spark: SparkSession, path: str, name: str | None = None) -> DataFrame | None:
    """The table, or an empty one of the declared schema if a name is given and nothing is there."""
    if exists(spark, path):
        return spark.read.parquet(path)
    return empty(spark, name) if name else None


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> str:
    """Overwrites (or appends to) a declared table; empty input leaves a table of the schema."""
    path = f"{root}/{name}.parquet"
    conform(df, name).write.mode(mode).parquet(path)
    return path


def write_buckets(papers: DataFrame, root: str) -> None:
    """Overwrites just the buckets of journal and year that occur in ``papers``."""
    out = conform(papers, "papers").withColumn("bucket_journal", F.col("journal_slug")).withColumn("bucket_year", F.coalesce(F.col("year"), F.lit(0)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_journal", "bucket_year").parquet(root)


def journals(papers: DataFrame) -> DataFrame:
    return papers.groupBy("journal_slug", "journal", "journal_ta").agg(F.count(F.lit(1)).alias("n_papers"))


def mesh(papers: DataFrame) -> DataFrame:
    """A row per heading; papers without headings vanish."""
    return papers.select("pmid", "journal_slug", "year", F.explode("mesh_headings").alias("heading"))


def register_corpus(spark: SparkSession, root: str) -> list[str]:
    """Views papers, journals and mesh; none if there is no corpus."""
    if not exists(spark, root):
        return []
    papers = read(spark, root)
    for name, df in (("papers", papers), ("journals", journals(papers)), ("mesh", mesh(papers))):
        df.createOrReplaceTempView(name)
    return ["papers", "journals", "mesh"]


def register_enrichment(spark: SparkSession, root: str) -> list[str]:
    """Views of the enrichment tables that exist; their names."""
    done = []
    for name in ENRICHMENT:
        if (df := read_optional(spark, f"{root}/{name}.parquet")) is not None:
            df.createOrReplaceTempView(name)
            done.append(name)
    return done


def describe(spark: SparkSession) -> dict[str, list[str]]:
    """Columns of all registered views."""
    return {t.name: spark.table(t.name).columns for t in spark.catalog.listTables() if t.isTemporary}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``new`` replaces the rows of ``old`` with its keys; of repeated keys in ``new`` the last by ``order`` stays."""
    if order:
        last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        new = new.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_manifest(path: str, payload: dict) -> None:
    """A bucket's JSON manifest, put in place at once."""
    body = payload | {"fetched_at": datetime.now(UTC).isoformat(timespec="seconds")}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(f"{path}.tmp").write_text(json.dumps(body, sort_keys=True, indent=2))
    os.replace(f"{path}.tmp", path)


def read_manifest(path: str) -> dict | None:
    """The manifest; None if missing or unreadable."""
    try:
        body = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None
    return body if isinstance(body, dict) else None


def read_staging(path: str) -> list | None:
    """A JSON list: None if missing or something else, empty if blank."""
    try:
        text = Path(path).read_text()
    except OSError:
        return None
    if not text.strip():
        return []
    try:
        body = json.loads(text)
    except ValueError:
        return None
    return body if isinstance(body, list) else None


def bucket_digest(ids: DataFrame, keys: list[str], id_column: str = "pmid") -> DataFrame:
    """A digest of the set of ids of each bucket, to tell unchanged buckets."""
    return ids.groupBy(*keys).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(id_column).cast("string"))), ","), 256).alias("digest"))


def changed_buckets(fresh: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets whose digest is new or differs."""
    return fresh.join(known.select(*keys, F.col("digest").alias("was")), keys, "left").filter("was IS NULL OR was <> digest").drop("was")


def write_failures(failures: DataFrame, path: str) -> bool:
    """JSON lines of failed records, raw text cut at 2000 characters; no file if there are none."""
    if failures.isEmpty():
        return False
    failures.withColumn("raw_xml", F.substring("raw_xml", 1, 2000)).write.mode("overwrite").json(path)
    return True


def read_cache(spark: SparkSession, path: str, schema_ddl: str) -> DataFrame:
    """Cached raw JSON documents by id (table of pmid, raw_json); corrupt ones come as null."""
    return spark.read.parquet(path).withColumn("document", F.from_json("raw_json", schema_ddl, {"mode": "PERMISSIVE"}))


def write_cache(df: DataFrame, path: str) -> None:
    """Raw JSON documents by id, in folders of the id's first two characters."""
    df.withColumn("shard", F.substring("pmid", 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def affiliation_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached lookups, misses included; blank keys are skipped."""
    return (read_optional(spark, path, "affiliation_cache")).filter("raw_string IS NOT NULL AND raw_string <> ''")


def read_labels_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A label sheet as text columns; its header must be the expected one."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if df.columns != header:
        raise ValueError(f"expected the columns {header}, got {df.columns}")
    return df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def _git(*args: str) -> str:
    try:
        return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return ""


def record_run(artifact: str, inputs: list[str], config: dict, spark: SparkSession | None = None) -> str:
    """A JSON sidecar with the code state, hashes of configuration and inputs, versions and time."""
    def digest(path: str) -> str | None:
        p = Path(path)
        files = sorted(x for x in p.rglob("*") if x.is_file()) if p.is_dir() else [p] if p.exists() else []
        if not files:
            return None
        total = hashlib.sha256()
        for f in files:
            with f.open("rb") as stream:
                for block in iter(lambda: stream.read(1 << 20), b""):
                    total.update(block)
        return total.hexdigest()

    import pyspark

    body = {
        "artifact": artifact, "git_sha": _git("rev-parse", "HEAD"), "git_dirty": bool(_git("status", "--porcelain")),
        "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest(), "config": config,
        "inputs": {p: digest(p) for p in inputs}, "versions": {"pyspark": pyspark.__version__}, "recorded_at": datetime.now(UTC).isoformat(timespec="seconds"),
    }
    if spark is not None:
        body["spark_conf"] = dict(spark.sparkContext.getConf().getAll())
    path = f"{artifact}.run.json"
    Path(path).write_text(json.dumps(body, sort_keys=True, indent=2, default=str))
    return path


def save_index(vectors: DataFrame, path: str, id_column: str = "pmid") -> None:
    """Vectors with their dense row ids, in id order."""
    with_row_ids(vectors, [F.col(id_column).asc()]).withColumn("row_id", F.col("row_id").cast("int")).write.mode("overwrite").parquet(path)


def with_row_ids(df: DataFrame, order: list[Column], name: str = "row_id") -> DataFrame:
    """Adds dense numbers from 0 in ``order``, which must tell rows apart. Ranges of rows are numbered on their own and
    moved by what stands before them; one task sees a row for each range only."""
    placed = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "row-ids")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select(F.col("_part"), F.coalesce(before, F.lit(0)).alias("_before")))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_before", "_own")


def flush_cache(spark: SparkSession, path: str, fresh: DataFrame, keys: list[str]) -> int:
    """Adds looked-up rows to a cache table: a new answer replaces an old one of its keys. The rows now held."""
    old = read_optional(spark, path)
    new = fresh if old is None else upsert(old, fresh, keys)
    replace_table(new, path)
    return spark.read.parquet(path).count()


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrites a table that ``df`` may read from: the new one is written beside it and takes its place by renaming,
    so a failure leaves one of both."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(hadoop(path)):
        files.delete(hadoop(f"{path}.old"), True)
        files.rename(hadoop(path), hadoop(f"{path}.old"))
    files.rename(hadoop(f"{path}.new"), hadoop(path))
    files.delete(hadoop(f"{path}.old"), True)
    spark.catalog.refreshByPath(path)
