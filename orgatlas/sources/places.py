"""The places source: nested rows of an open places dataset, flattened for search."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgatlas.functions import text as T

SCHEMA = """
id STRING, names STRUCT<primary:STRING>, taxonomy STRUCT<primary:STRING, hierarchy:ARRAY<STRING>, alternates:ARRAY<STRING>>,
websites ARRAY<STRING>, phones ARRAY<STRING>, emails ARRAY<STRING>, socials ARRAY<STRING>,
addresses ARRAY<STRUCT<freeform:STRING,locality:STRING,region:STRING,postcode:STRING,country:STRING>>,
confidence DOUBLE, operating_status STRING, bbox STRUCT<xmin:DOUBLE,xmax:DOUBLE,ymin:DOUBLE,ymax:DOUBLE>
"""
#: Degrees by which a country box is widened.
MARGIN = 0.01


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Columns that a file lacks are read as NULL."""
    return spark.read.schema(SCHEMA).parquet(path)


def within_box(places: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose box lies strictly inside (xmin, ymin, xmax, ymax), widened by a small margin; pushed to the scan."""
    x0, y0, x1, y1 = box
    return places.where((F.col("bbox.xmin") > x0 - MARGIN) & (F.col("bbox.xmax") < x1 + MARGIN) & (F.col("bbox.ymin") > y0 - MARGIN) & (F.col("bbox.ymax") < y1 + MARGIN))


#: Bits of each coordinate in a place's position on the curve, and degrees of the squares that a clustered table is laid out in.
CURVE_BITS, SQUARE = 12, 15


def curve(x: Column, y: Column) -> Column:
    """Position of a point on a Z-order curve over the globe: the bits of both coordinates in turn, so that near points mostly have near positions."""
    scale = lambda c, low, width: F.least(F.greatest(F.floor((c - low) / width * (1 << CURVE_BITS)), F.lit(0)), F.lit((1 << CURVE_BITS) - 1)).cast("long")
    a, b = scale(x, -180.0, 360.0), scale(y, -90.0, 180.0)
    bit = lambda c, k: F.shiftleft(F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")), k)
    return functools.reduce(operator.add, [F.shiftleft(bit(a, k), k) + F.shiftleft(bit(b, k), k + 1) for k in range(CURVE_BITS)])


def _squares(corner: Column) -> Column:
    return F.floor(corner / SQUARE).cast("int")


def write_clustered(places: DataFrame, path: str, group_bytes: int = 8 << 20) -> None:
    """Places laid out for box searches: folders by squares of ``SQUARE`` degrees, rows in the order of the curve inside them, so that the statistics of row groups (of about ``group_bytes``) rule most of them out.

    A place belongs to the square of its box's lower left corner; places without a box are in a folder of their own.
    """
    x, y = F.col("bbox.xmin"), F.col("bbox.ymin")
    rows = places.withColumns({"square_x": _squares(x), "square_y": _squares(y), "_z": curve(x, y)})
    rows = rows.repartitionByRange("square_x", "square_y", "_z").sortWithinPartitions("square_x", "square_y", "_z").drop("_z")
    rows.write.option("parquet.block.size", group_bytes).partitionBy("square_x", "square_y").parquet(path)


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], schema: str = SCHEMA) -> DataFrame:
    """``within_box`` over a clustered table: only the folders of the squares that the box touches are opened."""
    x0, y0, x1, y1 = box
    rows = spark.read.schema(f"{schema.strip().rstrip(',')}, square_x INT, square_y INT").parquet(path)
    near = lambda c, low, high: F.col(c).between(math.floor((low - MARGIN) / SQUARE), math.floor((high + MARGIN) / SQUARE))
    return within_box(rows.where(near("square_x", x0, x1) & near("square_y", y0, y1)), box).drop("square_x", "square_y")


#: Powers of two of degrees that a grid's cells may be wide.
LEAST_CELL, MOST_CELL = -6, 9


def within_boxes(points: DataFrame, boxes: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Every point with every box (box_id, x0, y0, x1, y1) that it lies in, borders included.

    A box takes the grid whose cells are no narrower than itself, and so touches at most four of them; a point looks into its one cell of every grid that boxes use. They meet by
    equality, the exact test follows. Rows with a missing coordinate are in no box; a box with crossed bounds holds nothing.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.greatest(F.lit(LEAST_CELL), F.least(F.lit(MOST_CELL), F.ceil(F.log2(F.greatest(side, F.lit(2.0**LEAST_CELL))))))
    told = boxes.where("x0 <= x1 and y0 <= y1").select("box_id", "x0", "y0", "x1", "y1", level.cast("int").alias("_level"))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    tiles = told.withColumn("_cx", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("_cy", F.explode(F.sequence(cell("y0"), cell("y1"))))
    used = [r[0] for r in told.select("_level").distinct().collect()]  # at most as many as there are grids
    if not used:
        used = [LEAST_CELL]
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, sorted(used))))).withColumn("_cx", cell(x)).withColumn("_cy", cell(y))
    met = placed.join(tiles, ["_level", "_cx", "_cy"]).where(F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1")))
    return met.select(*points.columns, "box_id")


def flatten(places: DataFrame) -> DataFrame:
    """One row per place with the first website, phone, e-mail and address."""
    address = F.get("addresses", F.lit(0))
    return places.select(
        "id",
        F.col("names.primary").alias("name"),
        F.col("taxonomy.primary").alias("category_primary"),
        F.coalesce("taxonomy.hierarchy", F.array().cast("array<string>")).alias("hierarchy"),
        F.coalesce("taxonomy.alternates", F.array().cast("array<string>")).alias("alternates"),
        *[F.get(f"{f}s", F.lit(0)).alias(f) for f in ("website", "phone", "email")],
        F.coalesce("socials", F.array().cast("array<string>")).alias("socials"),
        address["locality"].alias("city"),
        address["country"].alias("country"),
        T.joined_address(address["freeform"], address["locality"], address["region"], address["postcode"]).alias("registered_address"),
        F.round("confidence", 2).alias("confidence"),
        "operating_status",
    )


def write_country_extract(places: DataFrame, path: str, release: str) -> None:
    """Flat places by release and country (first address, upper case), for partition pruning later."""
    rows = flatten(places).withColumns({"release": F.lit(release), "country": F.upper("country")})
    rows.repartition("country").write.mode("append").partitionBy("release", "country").parquet(path)


def read_country_extract(spark: SparkSession, path: str, country: str, release: str | None = None) -> DataFrame:
    """One country of the given or the newest release; only its partition is read."""
    extract = spark.read.parquet(path)
    newest = release or extract.agg(F.max("release")).first()[0]
    return extract.where((F.col("release") == newest) & (F.col("country") == country.upper()))


def newest_release(rows: DataFrame, release: str = "release") -> DataFrame:
    """Rows of the newest release; releases are named by date."""
    latest = rows.agg(F.max(release).alias("_newest"))  # one row
    return rows.join(F.broadcast(latest), F.col(release) == F.col("_newest")).drop("_newest")


def older_releases(rows: DataFrame, release: str = "release") -> DataFrame:
    """Releases that may be pruned."""
    latest = rows.agg(F.max(release).alias("_newest"))
    return rows.select(release).distinct().crossJoin(F.broadcast(latest)).where(F.col(release) < F.col("_newest")).select(release)
