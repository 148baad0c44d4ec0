"""Readers for the landed inputs. Every reader has an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.functions import calendar as cal

# The published column order of the place and alternate-name dumps.
PLACE_COLUMNS = (
    "id name ascii alternates lat lon fclass fc cc cc2 adm1 adm2 adm3 adm4 pop elevation dem timezone modified"
).split()
ALTERNATE_COLUMNS = "alt_id id lang name preferred short colloquial historic start end".split()
COUNTRY_COLUMNS = (
    "iso2 iso3 iso_numeric fips name capital area population continent tld currency_code currency_name phone postal_format postal_regex languages"
    " geoname_id neighbours fips_equivalent"
).split()


def _tsv(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], min_fields: int, comment: str | None = None) -> DataFrame:
    """Tab-separated text without any quoting (names hold quotes); lines with fewer fields are dropped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    fields = lines.select(F.split("value", "\t").alias("p")).where(F.size("p") >= min_fields)
    return fields.select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)])


def read_index_series(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated index file: ``season, year, oni`` from the first, second and fourth token.

    The header and short lines have no number in these places and fall out.
    """
    tokens = F.split(F.btrim("value"), r"\s+")
    rows = spark.read.text(path).select(tokens.alias("p")).where(F.size("p") >= 4)
    typed = rows.select(F.col("p")[0].alias("season"), F.col("p")[1].try_cast("int").alias("year"), F.col("p")[3].try_cast("double").alias("oni"))
    return typed.where("year IS NOT NULL AND oni IS NOT NULL")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Place dump; rows with fewer than fifteen fields are dropped, an empty population is 0."""
    rows = _tsv(spark, path, PLACE_COLUMNS, 15)
    return rows.select(
        F.col("id").try_cast("bigint").alias("id"), "name", "ascii", F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"),
        "fclass", "fc", "cc", "adm1", "adm2", F.coalesce(F.col("pop").try_cast("bigint"), F.lit(0)).alias("pop"),
    )


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Country table; comment lines and blank lines are skipped."""
    return _tsv(spark, path, COUNTRY_COLUMNS, 1, comment="#").select("iso2", "name", "capital", "continent", "languages")


def read_code_names(spark: SparkSession, path: str) -> DataFrame:
    """Code tables of provinces and districts: ``code, name``."""
    return _tsv(spark, path, ["code", "name"], 2)


def read_alternate_names(spark: SparkSession, path: str) -> DataFrame:
    """Alternate names; short rows are dropped, a missing historic flag is empty."""
    rows = _tsv(spark, path, ALTERNATE_COLUMNS, 4)
    return rows.select(F.col("alt_id").try_cast("bigint").alias("alt_id"), F.col("id").try_cast("bigint").alias("id"), "lang", "name", "historic")


def read_fixes(spark: SparkSession, path: str, header: Sequence[str] | None = None) -> DataFrame:
    """Storm fixes from CSV with a header and a second line of units.

    Columns are found by name and ``USA_WIND`` may be absent. The units line has no time and falls out.
    """
    rows = spark.read.options(header=True, inferSchema=False, mode="PERMISSIVE").csv(path)
    usa = F.col("USA_WIND") if "USA_WIND" in rows.columns else F.lit(None).cast("string")
    typed = rows.select(
        F.col("SID").alias("sid"), F.col("ISO_TIME").try_cast("timestamp").alias("ts"), F.col("LAT").try_cast("double").alias("lat"),
        F.col("LON").try_cast("double").alias("lon"), F.col("BASIN").alias("basin"), F.col("NATURE").alias("nature"), F.col("WMO_WIND").alias("wmo_wind"),
        usa.alias("usa_wind"),
    )
    return typed.where("ts IS NOT NULL").withColumn("fix_id", F.xxhash64("sid", "ts", "lat", "lon"))


def read_json(spark: SparkSession, path: str, schema: str, multiline: bool = True) -> DataFrame:
    """JSON documents with a schema; an absent path gives an empty table of that schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=multiline)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_first_available(spark: SparkSession, readers: Sequence[tuple[str, object]]) -> DataFrame:
    """Read the first existing path: ``[(path, reader(spark, path)), …]``; the older source stands in for the newer."""
    for path, reader in readers:
        if path_exists(spark, path):
            return reader(spark, path)
    raise FileNotFoundError(", ".join(p for p, _ in readers))


OVERRIDE_SCHEMA = "season_names MAP<STRING, STRING>, hazards_add MAP<STRING, ARRAY<STRING>>"


def read_country_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per country, keyed by its folder ``iso2=…``, as Spark writes it, or else by its file name."""
    rows = spark.read.schema(OVERRIDE_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder, multiLine=True)
    by_folder = F.regexp_extract(F.col("_metadata.file_path"), r"/iso2=([^/]+)/", 1)
    key = F.when(by_folder != "", by_folder).otherwise(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)\.", 1))
    return rows.select(key.alias("iso2"), "season_names", "hazards_add")


def override_seasons(overrides: DataFrame) -> DataFrame:
    return overrides.select(F.col("iso2").alias("cc"), F.explode("season_names").alias("region_id", "local_season"))


def override_hazards(overrides: DataFrame) -> DataFrame:
    return overrides.select(F.col("iso2").alias("cc"), F.explode("hazards_add").alias("phase", "hazards_add"))


def read_polygons(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON features: ``ord``, the named properties and ``polygons`` (list of ring lists of [x, y]).

    A plain polygon becomes a list of one. ``properties`` is a DDL field list.
    """
    schema = f"features ARRAY<STRUCT<properties: STRUCT<{properties}>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("ord", "f"))
    multi = F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>>")
    single = F.array(F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>"))
    shapes = F.when(F.col("f.geometry.type") == "Polygon", single).otherwise(multi)
    return features.select("ord", "f.properties.*", shapes.alias("polygons"))


def polygon_edges(polygons: DataFrame, poly_id: str = "ord") -> DataFrame:
    """One row per side of every ring: ``poly_id, x1, y1, x2, y2``."""
    rings = polygons.select(F.col(poly_id).alias("poly_id"), F.explode(F.flatten("polygons")).alias("ring")).where(F.size("ring") > 1)
    ends = F.transform(F.slice("ring", F.lit(2), F.size("ring")), lambda p: p)
    sides = F.explode(F.arrays_zip(F.slice("ring", F.lit(1), F.size("ring") - 1).alias("a"), ends.alias("b")))
    return rings.select("poly_id", sides.alias("s")).select(
        "poly_id", F.get("s.a", F.lit(0)).alias("x1"), F.get("s.a", F.lit(1)).alias("y1"), F.get("s.b", F.lit(0)).alias("x2"), F.get("s.b", F.lit(1)).alias("y2")
    )


def decode_cube(rows: DataFrame, base_year: int, base_month: int, time: str = "t", rule: str = "mid_month") -> DataFrame:
    """Turn a "months since" coordinate into ``year`` and ``month``; NaN becomes NULL."""
    idx = cal.months_since(F.col(time), base_year, base_month, rule)
    value = F.when(~F.isnan("value"), F.col("value"))
    return rows.withColumns({"year": cal.index_year(idx), "month": cal.index_month(idx), "value": value}).drop(time)


CALENDAR_SCHEMA = (
    "country STRING, records ARRAY<STRUCT<crop: STRUCT<name: STRING>, aez: STRUCT<name: STRING>, sessions: ARRAY<STRUCT<all_year: STRING,"
    " early_sowing: STRUCT<month: INT>, later_sowing: STRUCT<month: INT>, early_harvest: STRUCT<month: INT>, late_harvest: STRUCT<month: INT>>>>>,"
    " _corrupt_record STRING"
)


def read_crop_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Landed crop calendar answers, one JSON line per country: session rows, and the lines that could not be read."""
    # cached by Spark's own rule: a corrupt-record column alone cannot be queried from the raw file
    raw = spark.read.text(path).select(F.from_json("value", CALENDAR_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("d"), "value")
    bad = raw.where("d._corrupt_record IS NOT NULL OR d.country IS NULL").select("value")
    good = raw.where("d._corrupt_record IS NULL AND d.country IS NOT NULL").select("d.country", F.explode("d.records").alias("r"))
    rows = good.select("country", "r.crop", "r.aez", F.explode_outer("r.sessions").alias("s")).where("trim(crop.name) <> ''")
    return (
        rows.select(
            F.col("country").alias("iso2"), F.trim("crop.name").alias("crop"), F.coalesce("aez.name", F.lit("")).alias("zone"), "s.all_year",
            F.col("s.early_sowing.month").alias("early_sowing"), F.col("s.later_sowing.month").alias("later_sowing"),
            F.col("s.early_harvest.month").alias("early_harvest"), F.col("s.late_harvest.month").alias("late_harvest"),
        ),
        bad,
    )


def zip_forecast(payloads: DataFrame, max_abs: float = 5000.0) -> DataFrame:
    """Parallel arrays ``time, anomaly, mean`` to monthly rows; non-finite and absurd values dropped."""
    rows = payloads.withColumn("z", F.explode(F.arrays_zip("time", "anomaly", "mean"))).drop("time", "anomaly", "mean")
    kept = [c for c in rows.columns if c != "z"]
    out = rows.select(*kept, F.substring("z.time", 1, 7).alias("ym"), "z.anomaly", "z.mean")
    return out.where(_finite(F.col("anomaly")) & _finite(F.col("mean")) & (F.abs("anomaly") < max_abs))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def read_scores(spark: SparkSession, path: str, codes: Sequence[str]) -> DataFrame:
    """Indicator scores: ``iso3, ind, score`` of the known codes."""
    rows = spark.read.schema("Iso3 STRING, IndicatorId STRING, IndicatorScore DOUBLE").json(path)
    return known_scores(rows.select(F.col("Iso3").alias("iso3"), F.col("IndicatorId").alias("ind"), F.col("IndicatorScore").alias("score")), codes)


def known_scores(rows: DataFrame, codes: Sequence[str]) -> DataFrame:
    return rows.where(F.col("ind").isin(list(codes)) & F.col("score").isNotNull() & F.col("iso3").isNotNull())


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed web pages: ``page_id, url, html``."""
    return spark.read.schema("page_id BIGINT, url STRING, html STRING").parquet(path)


def read_review_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Reviewer's CSV ``key, english, translation, status``: quoted fields with doubled quotes, blank lines dropped."""
    rows = spark.read.schema("key STRING, english STRING, translation STRING, status STRING").options(header=True, quote='"', escape='"', multiLine=True)
    return rows.csv(path).where("key IS NOT NULL")
