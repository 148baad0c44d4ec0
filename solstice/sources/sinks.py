"""Writers and gated publication."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from solstice.sources.readers import path_exists


# --- value preparation -------------------------------------------------------------------------
def whole(x: Column) -> Column:
    """Whole number, ties to even."""
    return F.bround(x, 0)


def decimals(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def significant(x: Column, digits: int) -> Column:
    """Keep ``digits`` decimals of the scientific notation, ties to even, as a double."""
    scale = F.pow(F.lit(10.0), F.lit(digits) - F.floor(F.log10(F.abs(x))))
    # the text form removes the noise of scaling back
    return F.when(x == 0, 0.0).otherwise(F.format_string(f"%.{digits}e", F.bround(x * scale, 0) / scale).cast("double"))


def provenance_struct(name: str, version, retrieved_at, url: str, licence: str, **extra: str) -> Column:
    """Struct stamped on an artefact; ``version`` and ``retrieved_at`` may be columns."""

    def text(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    fields = {"name": name, "version": version, "retrieved_at": retrieved_at, "url": url, "licence": licence, **extra}
    return F.struct(*[text(v).alias(k) for k, v in fields.items()])


# --- documents ---------------------------------------------------------------------------------
def documents_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int | None = None) -> DataFrame:
    """``keys, part, doc``: one JSON document per key with its rows in order.

    ``max_rows`` splits keys without a natural bound into parts of about that size.
    """
    body = [c for c in rows.columns if c not in keys]
    if max_rows is None:
        parted = rows.withColumn("part", F.lit(0))
    else:
        sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / max_rows).alias("_parts"))
        parted = rows.join(sizes, list(keys)).withColumn("part", F.pmod(F.xxhash64(*order), F.col("_parts")).cast("int"))
    entry = F.struct(*order, *[c for c in body if c not in order])
    docs = parted.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    return docs.select(*keys, "part", F.to_json(F.struct("rows")).alias("doc"))


def write_documents(docs: DataFrame, keys: Sequence[str], path: str) -> None:
    """One folder per key with the documents as text."""
    docs.select(*keys, F.col("doc").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, doubled quotes, header."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, quoteAll=True, quote='"', escape='"', **kept).csv(path)


def manifest(rows: DataFrame, key: str, built: str, sources: Sequence[str]) -> DataFrame:
    """One row: sorted distinct keys, row count, build date and sources."""
    names = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return names.agg(F.array_sort(F.collect_list(key)).alias("keys"), F.sum("_n").alias("count")).select(
        "keys", "count", F.lit(built).alias("built"), F.array(*[F.lit(s) for s in sources]).alias("sources")
    )


def manifest_pages(rows: DataFrame, key: str, staging: str, page_size: int = 10_000) -> DataFrame:
    """``page, first, last, n_keys, count, keys``: the sorted distinct keys in pages of ``page_size``, for any number of keys.

    Without ``keys`` the rows are the root, which says where to look. Keys are dealt into ranges and sorted there, written to
    ``staging`` once, and numbered by the sizes of the ranges before; no task holds more than a range or a page.
    """
    spark = rows.sparkSession
    names = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    names.repartitionByRange("key").sortWithinPartitions("key").withColumn("_at", F.monotonically_increasing_id()).write.parquet(staging)
    placed = spark.read.schema(names.schema.add("_at", "long")).parquet(staging).withColumn("_range", F.shiftright("_at", 33))
    # one row per range
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))
    page = F.floor((F.col("_before") + F.col("_at").bitwiseAND(2**33 - 1)) / page_size)
    paged = placed.join(before, "_range").select(page.alias("page"), "key", "n").groupBy("page")
    return paged.agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n_keys"), F.sum("n").alias("count"), F.array_sort(F.collect_list("key")).alias("keys"))


def size_report(docs: DataFrame, doc: str = "doc") -> DataFrame:
    return docs.agg(F.count("*").alias("n"), F.max(F.octet_length(doc)).cast("bigint").alias("largest"), F.sum(F.octet_length(doc)).alias("total"))


# --- publication -------------------------------------------------------------------------------
class GateFailed(RuntimeError):
    """A quality gate refused the new build; the last good one stays current. ``path`` holds the refused run."""

    path: str = ""


@dataclass
class Published:
    run_id: str
    paths: list[str]


@dataclass(frozen=True)
class Measure:
    """An aggregate of a build that must lie in ``lo..hi``; measured while the build is written."""

    gate: str
    value: Column
    lo: float
    hi: float

    def passes(self, value: float | None) -> bool:
        return value is not None and self.lo <= value <= self.hi


#: Measures, or a function from the written table to gate rows ``gate, ok, …`` for what no plain aggregate can say.
Gates = Sequence[Measure] | Callable[[DataFrame], DataFrame]


def range_measures(bounds: dict[str, tuple[float, float]]) -> list[Measure]:
    """No value of a column outside its range; nulls are allowed."""
    return [Measure(f"range of {c}", F.count_if(~F.col(c).between(lo, hi)).cast("double"), 0.0, 0.0) for c, (lo, hi) in bounds.items()]


def size_measure(gate: str, lo: float, hi: float, value: Column | None = None) -> Measure:
    """Row count, or another aggregate, inside ``lo..hi``."""
    return Measure(gate, (F.count(F.lit(1)) if value is None else value).cast("double"), float(lo), float(hi))


def finite_measures(columns: Sequence[str]) -> list[Measure]:
    """Every number finite or null."""
    odd = {c: F.isnan(F.col(c)) | (F.abs(F.col(c)) == float("inf")) for c in columns}
    return [Measure(f"finite {c}", F.count_if(x).cast("double"), 0.0, 0.0) for c, x in odd.items()]


def publish(df: DataFrame, root: str, gates: Gates | None = None, run_id: str | None = None, append: bool = False) -> Published:
    """Write to a new run folder, check it, then move the pointer ``current.json``.

    Measures are observed on the rows as they are written: one scan of the input, and none of the output. They stand
    right before the write, in the stage that writes, where a partition counts once however often it is tried.
    A function is called with the written table instead. The pointer moves only when all gates are ok; otherwise
    readers keep the last good run and ``GateFailed`` is raised. ``append`` keeps the earlier runs current
    too, so that they are never rewritten.
    """
    spark = df.sparkSession
    run_id = run_id or uuid.uuid4().hex[:12]
    path = f"{root.rstrip('/')}/runs/{run_id}-{uuid.uuid4().hex[:6]}"
    if gates is None or callable(gates):
        df.write.mode("errorifexists").parquet(path)
        # gate rows are one per check
        failed = _failed(gates, spark.read.parquet(path)) if gates is not None else []
    else:
        failed = _write_measured(df, path, gates)
    if failed:
        refusal = GateFailed(", ".join(failed))
        refusal.path = path
        raise refusal
    earlier = pointer(spark, root)
    paths = [*(earlier.paths if append and earlier else []), path]
    _replace_text(spark, f"{root.rstrip('/')}/current.json", json.dumps({"run_id": run_id, "paths": paths}))
    return Published(run_id, paths)


def _write_measured(df: DataFrame, path: str, measures: Sequence[Measure]) -> list[str]:
    """Write and measure in one job; the gates that fail."""
    if not measures:
        df.write.mode("errorifexists").parquet(path)
        return []
    seen = Observation(f"gates-{uuid.uuid4().hex[:8]}")
    df.observe(seen, *[m.value.alias(f"m{i}") for i, m in enumerate(measures)]).write.mode("errorifexists").parquet(path)
    got = seen.get
    return [m.gate for i, m in enumerate(measures) if not m.passes(got.get(f"m{i}"))]


def _failed(gates: Gates, made: DataFrame) -> list[str]:
    """The gates that a table which is already written fails."""
    if callable(gates):
        return [r["gate"] for r in gates(made).where(~F.coalesce("ok", F.lit(False))).select("gate").collect()]
    if not gates:
        return []
    got = made.agg(*[m.value.alias(f"m{i}") for i, m in enumerate(gates)]).first()
    return [m.gate for i, m in enumerate(gates) if not m.passes(got[f"m{i}"])]


def compact(spark: SparkSession, root: str) -> Published | None:
    """Write what is current as one run and point at it alone; the rows stay, the list of paths becomes one."""
    now = pointer(spark, root)
    if now is None or len(now.paths) == 1:
        return now
    path = f"{root.rstrip('/')}/runs/{now.run_id}-{uuid.uuid4().hex[:6]}"
    spark.read.parquet(*now.paths).write.mode("errorifexists").parquet(path)
    _replace_text(spark, f"{root.rstrip('/')}/current.json", json.dumps({"run_id": now.run_id, "paths": [path]}))
    return Published(now.run_id, [path])


def refused(spark: SparkSession, root: str) -> list[str]:
    """Runs that wait for another try."""
    path = f"{root.rstrip('/')}/refused.json"
    return list(spark.read.schema("paths ARRAY<STRING>").json(path).first()["paths"]) if path_exists(spark, path) else []


def keep_refused(spark: SparkSession, root: str, paths: list[str]) -> None:
    _replace_text(spark, f"{root.rstrip('/')}/refused.json", json.dumps({"paths": paths}))


def retry_refused(spark: SparkSession, root: str, gates: Gates) -> list[str]:
    """Try the refused runs again; those that pass now become current. Returns the paths still refused."""
    waiting = refused(spark, root)
    passed = [p for p in waiting if not _failed(gates, spark.read.parquet(p))]
    if passed:
        now = pointer(spark, root)
        run_id, paths = (now.run_id, now.paths) if now else ("0", [])
        # a run that is listed already was taken over by a try that stopped before it could say so
        _replace_text(spark, f"{root.rstrip('/')}/current.json", json.dumps({"run_id": run_id, "paths": [*paths, *(p for p in passed if p not in paths)]}))
        keep_refused(spark, root, [p for p in waiting if p not in passed])
    return [p for p in waiting if p not in passed]


def pointer(spark: SparkSession, root: str) -> Published | None:
    """What is current, or None before the first publication."""
    path = f"{root.rstrip('/')}/current.json"
    if not path_exists(spark, path):
        return None
    row = spark.read.schema("run_id STRING, paths ARRAY<STRING>").json(path).first()
    return Published(row["run_id"], list(row["paths"]))


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The table the pointer names."""
    now = pointer(spark, root)
    return None if now is None else spark.read.parquet(*now.paths)


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file next to the target and rename it over, through the Hadoop file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(staged, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, target, overwrite)
