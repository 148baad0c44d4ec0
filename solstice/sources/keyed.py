"""Tables with keys: an update replaces rows by key and rewrites only the parts it touches.

A table is dealt into a fixed number of parts by a hash of its key. ``current.json`` names the folder of every part, so an
update writes the touched parts to a new run, takes all others over as they are, and moves the pointer at the end:
readers see the table before or after it, never between. Folders that an update replaced stay readable until
``remove_replaced`` drops them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from solstice.sources import sinks
from solstice.sources.readers import path_exists

PART = "_part"


@dataclass
class State:
    """What ``current.json`` says: parts, their folders, and the folders that earlier updates replaced, by run."""

    run_id: str
    keys: list[str]
    n_parts: int
    schema: StructType
    parts: dict[int, str] = field(default_factory=dict)
    replaced: list[tuple[str, list[str]]] = field(default_factory=list)


def state(spark: SparkSession, root: str) -> State | None:
    path = f"{root.rstrip('/')}/current.json"
    if not path_exists(spark, path):
        return None
    said = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return State(said["run_id"], said["keys"], said["n_parts"], StructType.fromJson(said["schema"]), {int(k): v for k, v in said["parts"].items()}, [(r, p) for r, p in said["replaced"]])


def _point_at(spark: SparkSession, root: str, new: State) -> None:
    said = {"run_id": new.run_id, "keys": new.keys, "n_parts": new.n_parts, "schema": new.schema.jsonValue(), "parts": new.parts, "replaced": new.replaced}
    sinks._replace_text(spark, f"{root.rstrip('/')}/current.json", json.dumps(said))


def read(spark: SparkSession, root: str, only: Sequence[int] | None = None) -> DataFrame | None:
    """The table, or some of its parts; None before the first update."""
    now = state(spark, root)
    if now is None:
        return None
    paths = [p for k, p in sorted(now.parts.items()) if only is None or k in only]
    return spark.read.schema(now.schema).parquet(*paths) if paths else spark.createDataFrame([], now.schema)


def upsert(changes: DataFrame, root: str, keys: Sequence[str], order: Sequence[str] = (), gone: str | None = None, n_parts: int = 64, gates: Sequence[sinks.Measure] = (), run_id: str | None = None) -> State:
    """Put the rows of ``changes`` in the place of those with the same key (null keys are keys too), and add the others.

    Of several changes of a key, and of a change and the row that stands, the one with the greatest ``order`` wins; at a tie the
    change does, and of changes that tie the greatest one column by column. Rows with ``gone`` true take the key away (the column
    itself is not kept, so a later change with a smaller order can bring the key back). ``gates`` are measured on the
    rewritten parts while they are written; a refused update leaves the table as it was and raises ``GateFailed``. ``n_parts`` and
    the columns are those of the first update from then on.
    """
    spark = changes.sparkSession
    now = state(spark, root)
    if now is not None and now.keys != list(keys):
        raise ValueError(f"the table has the keys {now.keys}")
    n_parts = now.n_parts if now else n_parts
    schema = now.schema if now else StructType([f for f in changes.schema.fields if f.name != gone])
    columns = schema.fieldNames()
    taken = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    part = F.pmod(F.xxhash64(*[F.col(k).cast(schema[k].dataType) for k in keys]), F.lit(n_parts)).cast("int")
    arrived = changes.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in columns], taken.alias("_gone"), F.lit(1).alias("_new"), part.alias(PART))
    # at most n_parts rows
    touched = sorted(r[PART] for r in arrived.select(PART).distinct().collect())
    run_id = run_id or uuid.uuid4().hex[:12]
    path = f"{root.rstrip('/')}/runs/{run_id}-{uuid.uuid4().hex[:6]}"
    standing = [now.parts[k] for k in touched if now and k in now.parts]
    rows = arrived
    if standing:
        old = spark.read.schema(schema).parquet(*standing).withColumns({"_gone": F.lit(False), "_new": F.lit(0)}).withColumn(PART, part)
        rows = old.unionByName(arrived)
    rest = [c for c in columns if c not in order and c not in keys and schema[c].dataType.typeName() not in ("map", "variant")]
    newest = F.struct(*order, "_new", *rest).alias("_rank")
    kept = rows.groupBy(PART, *keys).agg(F.max_by(F.struct("_gone", *[c for c in columns if c not in keys]), newest).alias("_r"))
    merged = kept.where("NOT _r._gone").select(PART, *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in columns])
    # a part is written by one task: few files, and readers of one part open one
    dealt = merged.repartition(max(1, len(touched)), PART)
    written = F.count(F.lit(1)).alias("rows")
    seen, measures = sinks.Observation(f"keyed-{uuid.uuid4().hex[:8]}"), list(gates)
    observed = dealt.observe(seen, written, *[m.value.alias(f"m{i}") for i, m in enumerate(measures)])
    observed.write.partitionBy(PART).mode("errorifexists").parquet(path)
    got = seen.get
    failed = [m.gate for i, m in enumerate(measures) if not m.passes(got.get(f"m{i}"))]
    if failed:
        refusal = sinks.GateFailed(", ".join(failed))
        refusal.path = path
        raise refusal
    made = {k: f"{path}/{PART}={k}" for k in touched if path_exists(spark, f"{path}/{PART}={k}")}
    parts = {k: p for k, p in (now.parts if now else {}).items() if k not in touched} | made
    new = State(run_id, list(keys), n_parts, schema, parts, [*(now.replaced if now else []), (run_id, standing)])
    _point_at(spark, root, new)
    return new


def remove_replaced(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete the folders that updates replaced, but for those of the last ``keep``; gives their number."""
    now = state(spark, root)
    if now is None:
        return 0
    old, kept = (now.replaced[:-keep], now.replaced[-keep:]) if keep else (now.replaced, [])
    doomed = [p for _, paths in old for p in paths]
    # the pointer first: a stop in between leaves folders that nothing names, never names without folders
    _point_at(spark, root, State(now.run_id, now.keys, now.n_parts, now.schema, now.parts, kept))
    for p in doomed:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(doomed)


def refresh(stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], order: Sequence[str] = (), gone: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None, gates: Sequence[sinks.Measure] = (), n_parts: int = 64) -> list[tuple[int, str]]:
    """Bring the files that arrived since the last run into a keyed table; returns the refused batches with the reason.

    A corrected row replaces the earlier one of its key. A batch that was applied before a restart is applied again to the
    same result, as the greatest ``order`` wins; without ``order`` it is skipped by its number.
    """
    refused: list[tuple[int, str]] = []

    def apply(batch: DataFrame, epoch: int) -> None:
        now = state(batch.sparkSession, root)
        if now is not None and now.run_id.isdigit() and int(now.run_id) >= epoch:
            return
        try:
            upsert(batch if transform is None else transform(batch), root, keys, order, gone, n_parts, gates, run_id=f"{epoch:09d}")
        except sinks.GateFailed as failure:
            refused.append((epoch, str(failure)))

    query: StreamingQuery = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return refused
