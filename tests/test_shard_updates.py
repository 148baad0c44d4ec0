import json
import os

import pytest
from pyspark.sql import functions as F

from solstice.operators import gazetteer as op
from solstice.sources import keyed, sinks

PLACES = "id LONG, name STRING, cc STRING, a1 STRING, a2 STRING, lat DOUBLE, lon DOUBLE, pop LONG"


def place(i, name, pop=10, cc="AA"):
    return (i, name, cc, "", None, 1.23456, 2.0, pop)


def build(spark, rows):
    places = spark.createDataFrame(rows, PLACES)
    return op.assign_shards(op.search_keys(places), max_rows=5), places


def documents(df):
    return {(r.shard, r.part): (r.n, json.loads(r.doc)) for r in df.collect()}


def update(spark, rows, root, **more):
    keys, places = build(spark, rows)
    changed = {(r.shard, r.gone) for r in op.update_shards(keys, places, root, max_rows=5, n_parts=32, **more).collect()}
    # the result is that of a full build
    assert documents(op.current_documents(spark, root)) == documents(op.shard_payloads(keys, places, 5))
    return changed


def files_of(spark, root):
    return {k: frozenset(os.listdir(p.removeprefix("file:"))) for k, p in keyed.state(spark, f"{root}/documents").parts.items()}


def test_updates_rewrite_only_what_changed(spark, scratch):
    root = f"{scratch}/shards"
    names = [f"{a}{b}{c}" for a in "abcdef" for b in "xyz" for c in ("la", "mo")]
    rows = [place(i, n) for i, n in enumerate(names)]
    first = update(spark, rows, root)
    assert first == {(n[:2], False) for n in names}
    assert update(spark, rows[::-1], root) == set()  # the same build in another order
    before = files_of(spark, root)
    rows.append(place(100, "axle"))
    assert update(spark, rows, root) == {("ax", False)}  # one added place, one shard
    after = files_of(spark, root)
    assert sum(before.get(k) != after[k] for k in after) == 1
    rows[0] = place(0, "axla", pop=99)
    rows[3] = place(3, "aymo", cc=None)  # a null is not the empty text
    assert update(spark, rows, root) == {("ax", False), ("ay", False)}
    rows[3] = place(3, "aymo", cc="")
    assert update(spark, rows, root) == {("ay", False)}
    # a shard that grows past its limit gives way to longer ones, and comes back
    more = [place(200 + i, f"bx{c}") for i, c in enumerate("abcdefg")]
    assert update(spark, rows + more, root) >= {("bx", True), ("bxa", False), ("bxl", False)}
    assert update(spark, rows, root) >= {("bx", False), ("bxa", True)}
    # one key of many places is written in parts, and the parts go with it
    same = [place(300 + i, "cxcxcxcxcx") for i in range(40)]
    update(spark, rows + same, root)
    assert len([k for k in documents(op.current_documents(spark, root)) if k[0] == "cxcxcxcxc"]) > 1
    update(spark, rows, root)
    assert update(spark, [], root) == {(s, True) for s in {n[:2] for n in names}}


def test_a_refused_update_changes_nothing(spark, scratch):
    root = f"{scratch}/refused"
    update(spark, [place(1, "axla")], root)
    keys, places = build(spark, [place(1, "axla"), place(2, "axmo")])
    with pytest.raises(sinks.GateFailed):
        op.update_shards(keys, places, root, 5, gates=sinks.range_measures({"n": (0, 1)}))
    assert [r.n for r in op.current_documents(spark, root).collect()] == [1]
    # the next update that passes still sees the change
    assert update(spark, [place(1, "axla"), place(2, "axmo")], root) == {("ax", False)}
    assert op.current_documents(spark, root).select(F.sum("n")).first()[0] == 2
