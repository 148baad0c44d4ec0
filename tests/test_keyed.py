import os
import random

import pytest
from pyspark.sql import functions as F

from solstice.operators import catalog
from solstice.sources import keyed, sinks
from solstice.streaming import refresh

DDL = "k STRING, v DOUBLE, at INT"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files_under(paths):
    return {f"{d}/{f}" for p in paths for d, _, names in os.walk(p.removeprefix("file:")) for f in names if f.endswith(".parquet")}


def test_a_corrected_row_replaces_the_old_one_and_untouched_parts_keep_their_files(spark, scratch):
    root = f"{scratch}/t"
    first = keyed.upsert(spark.createDataFrame([(f"k{i}", float(i), 1) for i in range(200)], DDL), root, ["k"], ["at"], n_parts=16)
    assert len(first.parts) == 16 and keyed.read(spark, root).count() == 200
    before = {k: files_under([p]) for k, p in first.parts.items()}
    second = keyed.upsert(spark.createDataFrame([("k7", 70.0, 2), ("k8", -1.0, 0)], DDL), root, ["k"], ["at"])
    moved = {k for k in first.parts if first.parts[k] != second.parts[k]}
    assert 1 <= len(moved) <= 2
    assert all(files_under([second.parts[k]]) == before[k] for k in first.parts if k not in moved)
    got = {r.k: (r.v, r.at) for r in keyed.read(spark, root).collect()}
    assert len(got) == 200 and got["k7"] == (70.0, 2) and got["k8"] == (8.0, 1)  # an older change does not win
    # readers of the state before still can, until replaced folders go
    assert spark.read.parquet(*first.parts.values()).count() == 200
    assert keyed.remove_replaced(spark, root, keep=0) == len(moved)
    assert keyed.read(spark, root).count() == 200 and keyed.remove_replaced(spark, root, keep=0) == 0


def test_updates_in_any_cut_give_what_a_dictionary_gives(spark, scratch):
    rnd = random.Random(4)
    root, want = f"{scratch}/d", {}
    for step in range(5):
        changes = [(rnd.choice([None, *"abcdefghij"]), rnd.choice([None, 1.0, 2.0]), step, rnd.random() < 0.2) for _ in range(15)]
        for k, v, at, gone in sorted(changes, key=lambda c: (c[2], c[1] is not None, c[1] or 0, c[3])):
            want[k] = (v, at, gone)
        # one change of a key at a time, so that nothing hangs on ties
        unique = [(k, *want[k]) for k in {c[0] for c in changes}]
        want = {k: x for k, x in want.items() if not x[2]}
        keyed.upsert(spark.createDataFrame(unique, DDL + ", gone BOOLEAN"), root, ["k"], ["at"], gone="gone", n_parts=4)
        assert rows_of(keyed.read(spark, root)) == sorted(((k, v, at) for k, (v, at, _) in want.items()), key=str)
    empty = keyed.upsert(spark.createDataFrame([], DDL), root, ["k"], ["at"])
    assert rows_of(keyed.read(spark, root)) == sorted(((k, v, at) for k, (v, at, _) in want.items()), key=str) and empty.n_parts == 4
    keyed.upsert(spark.createDataFrame([(k, None, 99, True) for k in want], DDL + ", gone BOOLEAN"), root, ["k"], ["at"], gone="gone")
    assert keyed.read(spark, root).count() == 0 and keyed.state(spark, root).parts == {}


def test_a_refused_update_leaves_the_table(spark, scratch):
    root, check = f"{scratch}/r", sinks.range_measures({"v": (0, 10)})
    assert keyed.read(spark, root) is None
    keyed.upsert(spark.createDataFrame([("a", 1.0, 1)], DDL), root, ["k"], gates=check)
    with pytest.raises(sinks.GateFailed, match="range of v"):
        keyed.upsert(spark.createDataFrame([("a", 11.0, 2), ("b", 1.0, 2)], DDL), root, ["k"], gates=check)
    assert rows_of(keyed.read(spark, root)) == [("a", 1.0, 1)]
    with pytest.raises(ValueError, match="keys"):
        keyed.upsert(spark.createDataFrame([("a", 1.0, 1)], DDL), root, ["v"])


def test_arriving_files_update_by_key(spark, scratch):
    land, root, state = f"{scratch}/land", f"{scratch}/root", f"{scratch}/state"

    def arrive(*rows):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(land)
        return keyed.refresh(refresh.file_stream(spark, land, DDL), root, state, ["k"], ["at"], gates=sinks.range_measures({"v": (0, 100)}), n_parts=4)

    assert arrive(("a", 1.0, 1), ("b", 2.0, 1)) == []
    assert arrive(("a", 5.0, 2), ("c", 3.0, 1)) == []
    assert arrive(("a", 4.0, 1)) == []  # late, and older than what stands
    assert rows_of(keyed.read(spark, root)) == [("a", 5.0, 2), ("b", 2.0, 1), ("c", 3.0, 1)]
    assert [e for e, _ in arrive(("b", 500.0, 2))] == [3]
    assert arrive(("b", 50.0, 3)) == [] and rows_of(keyed.read(spark, root))[1] == ("b", 50.0, 3)


def test_translations_as_changes_of_a_keyed_table(spark, scratch):
    root = f"{scratch}/catalog"
    source = spark.createDataFrame([(f"k{i}", f"text {i}") for i in range(30)], "k STRING, value STRING")
    target = spark.createDataFrame([(f"k{i}", f"texte {i}", "h", False) for i in range(20)] + [("old", "x", "h", True)], "k STRING, value STRING, src_hash STRING, mt BOOLEAN")
    done = spark.createDataFrame([("k3", "neu"), ("k25", "neu 25"), ("unknown", "?")], "k STRING, value STRING")
    lists = spark.createDataFrame([("k29",)], "k STRING")
    keyed.upsert(target, root, ["k"], n_parts=8)
    changes = catalog.translation_changes(source, keyed.read(spark, root), done, lists)
    assert {(r.k, r.gone) for r in changes.collect()} == {("k3", False), ("k25", False), ("k29", False), ("old", True)}
    want = rows_of(catalog.apply_translations(source, target, done, lists).select("k", "value", "src_hash", "mt"))
    keyed.upsert(changes, root, ["k"], gone="gone")
    assert rows_of(keyed.read(spark, root).select("k", "value", "src_hash", "mt")) == want
    assert keyed.read(spark, root).where(F.col("k") == "old").count() == 0
