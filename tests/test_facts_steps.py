"""Steps of the facts job that must not grow with the number of layers, or stay in one task."""

from solstice.operators import cube, spatial
from solstice.plans import briefing, views
from solstice.plans.queries import rules as rules_q

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_items_are_gathered_once_for_composites(spark):
    composites = rules_q.fact_inputs(views.Tables(spark, FOLDER)).composites
    assert composites.inputFiles() and not [f for f in composites.inputFiles() if "lineitem" in f]


def test_places_of_one_file_become_many_tasks(spark):
    assert "RepartitionByExpression [place_id#" in plan(rules_q.facts(views.Tables(spark, FOLDER)).select("place_id"))


def test_distances_are_worked_out_once_a_point(spark):
    points = spark.createDataFrame([(1, 0.0, 0.5), (2, 40.5, 40.5), (3, 1.0, 1.0)], "id INT, lat DOUBLE, lon DOUBLE")
    snapped = spatial.snap_to_land(points, spark.createDataFrame([(46, 90)], "i INT, j INT"))
    assert plan(snapped).count("ASIN(") == 1
    rows = {r.id: (r.cell_id, r.own_is_land, r.on_land) for r in snapped.collect()}
    assert rows == {1: ("+003.0_+0001.0", False, True), 2: ("+041.0_+0041.0", False, False), 3: ("+003.0_+0001.0", False, True)}


def test_forecast_months_are_sorted_and_added_once(spark):
    rows = spark.createDataFrame([(1, "2026-10", 40.0, 100.0), (1, "2026-11", 50.0, 100.0), (2, "2026-10", 1.0, 2.0), (3, "2026-10", float("nan"), 90.0)], "id INT, ym STRING, anomaly DOUBLE, mean DOUBLE")
    made = cube.forecast_reduction(rows, ["id"], 3)
    # the filter for rows without a result is written once more
    assert plan(made).count("array_sort(") <= 2 and plan(made).count("aggregate(") <= 4
    assert [tuple(r) for r in made.drop("monthly").collect()] == [(1, 82, False, 2, 3, 110, 90)]


def test_catalog_is_looked_up_once_a_language(spark):
    looked_up = briefing._looked_up(briefing.english_catalog(spark)).first()
    assert looked_up._fixed.ui_sources == "Sources" and looked_up._months[0] == "Jan"
    assert set(looked_up._of.usdm_levels_) == {f"usdm_levels.{i}" for i in range(5)}
