import random

from pyspark.sql import functions as F

from solstice.operators import cube as op
from solstice.operators import running
from solstice.sources import keyed

EVENTS = [(1, "en", 1996), (2, "en", 1998), (3, "en", 1999), (1, "ln", 1995), (2, "ln", 1997), (3, "ln", 1999)]


def rows_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_three_added_months_give_what_the_whole_cube_gives(spark, scratch):
    rnd = random.Random(2)
    rows = [(s, c, y, m, None if rnd.random() < 0.05 else float(rnd.randint(0, 90))) for s in "ab" for c in range(5) for y in range(1995, 2001) for m in range(1, 13)]
    whole = spark.createDataFrame(rows, "source STRING, cell INT, year INT, month INT, value DOUBLE")
    months = op.event_months(spark, spark.createDataFrame(EVENTS, "ord INT, phase STRING, anchor INT"))
    at = F.col("year") * 12 + F.col("month")
    last, root = 2000 * 12 + 12, f"{scratch}/running"
    cuts = [whole.where(at <= last - 3), *(whole.where(at == last - k) for k in (2, 1, 0))]
    for i, cut in enumerate(cuts):
        for _ in range(2 if i == 2 else 1):  # a month that is added twice counts once
            running.add_months(cut, root, months, 1996, 2000, f"{i:04d}", n_parts=4)
        held = whole.where(at <= last - 3 + i)
        clim = op.climatology(held, 1996, 2000)
        assert rows_of(running.climatology(spark, root)) == rows_of(clim.select("source", "cell", "month", "clim", "n"))
    full = op.event_anomalies(whole, clim, months)
    by = ("source", "cell", "phase", "k")
    assert rows_of(op.composite(running.anomalies(spark, root), by, digits=4)) == rows_of(op.composite(full, by, digits=4))
    # months without an event leave the season table alone
    before = keyed.state(spark, f"{root}/seasons").parts
    running.add_months(spark.createDataFrame([("a", 0, 2030, 1, 5.0)], whole.schema), root, months, 1996, 2000, "0009", n_parts=4)
    assert keyed.state(spark, f"{root}/seasons").parts == before


def test_running_composite_gathers_the_line_items_once(spark, monkeypatch):
    import __spark_entry__

    read = []
    monkeypatch.setattr(running, "add_months", lambda cube, *rest, **named: read.append(cube.inputFiles()))
    monkeypatch.setattr(running, "anomalies", lambda *rest: spark.createDataFrame([], "cell INT, source STRING, phase STRING, k INT, pct DOUBLE"))
    __spark_entry__.queries()["d9_running_composite"](spark, "/root/testdata/sf0.001")
    assert len(read) == 3 and all("running-cube" in f for files in read for f in files)
