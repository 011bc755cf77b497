"""Rasters, catalogs, timelines and request streams derived from the provided tables.

There are no image files among them, so the operators run on data of the same
shape: each fixture is a fixed expression over one table, defined alike in
``tilescope.plans.fixtures_sql`` for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px(image, x, y, r, g, b, a): an image for each label, a row of 64 pixels for each vector."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("image"),
        (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"),
        "embedding",
    )
    rows = rows.select("image", "y", F.posexplode("embedding").alias("x", "e"))
    red = rows.select("image", "x", "y", F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int").alias("r"))
    return red.select(
        "image",
        "x",
        "y",
        "r",
        ((F.col("r") * 7 + F.col("x")) % 256).alias("g"),
        ((F.col("r") * 13 + F.col("y")) % 256).alias("b"),
        F.when(F.col("x") % 16 == 0, 0).otherwise(255).alias("a"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid(image, x, y, v): 61 x 37 with values 0..255, both sides odd; cells without a row hold 0."""
    cells = spark.range(61 * 37).select((F.col("id") % 61).cast("int").alias("x"), F.expr("int(id div 61)").alias("y"))
    values = (
        table(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_orderkey") % 61).cast("int").alias("x"), (F.col("l_partkey") % 37).cast("int").alias("y"))
        .agg(F.max((F.col("l_quantity") * 5).cast("int")).alias("v"))
    )
    return cells.join(values, ["x", "y"], "left").select(F.lit(0).alias("image"), "x", "y", F.coalesce("v", F.lit(0)).alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fr(image, frame, stated): an animation for each order, a frame for each line; stated delay in ms, null on every 7th order's first lines."""
    # line numbers repeat within an order
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"),
        F.row_number().over(order).alias("frame"),
        F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") == 1), F.lit(None)).otherwise((F.col("l_quantity") * 2).cast("int")).alias("stated"),
    )


#: Fixed values of the catalog fixture.
PREFIXES = ("img", "IMG", "scan-0", "a_")
ENDINGS = (".jpg", ".PNG", ".txt", ".webp", ".tiff", "")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cat(folder, path, name, length, mtime): a file for each order."""
    pick = lambda some, n: F.element_at(F.array(*map(F.lit, some)), (F.col("o_orderkey") % n + 1).cast("int"))
    orders = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("folder"),
        F.concat(pick(PREFIXES, 4), (F.col("o_orderkey") % 997).cast("string"), pick(ENDINGS, 6)).alias("name"),
        F.when(F.col("o_orderkey") % 50 == 0, -1).otherwise(F.floor(F.col("o_totalprice") * 100)).cast("long").alias("length"),
        F.col("o_orderdate").alias("mtime"),
        "o_orderkey",
    )
    return orders.select("folder", F.concat(F.lit("/f"), F.col("folder").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("/"), "name").alias("path"), "name", "length", "mtime")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req(session, generation, ts, idx, count): the events of each user as requests for one of 50 files."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"),
        F.row_number().over(order).alias("generation"),
        "ts",
        (F.floor(F.col("value") * 10).cast("long") % 50).cast("int").alias("idx"),
        F.lit(50).alias("count"),
    )


def cache_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cachef(folder, file, mtime, bytes): cache files of a few folders, a file for each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("folder"),
        F.col("o_orderkey").alias("file"),
        F.col("o_orderdate").alias("mtime"),
        F.floor(F.col("o_totalprice") * 1000).cast("long").alias("bytes"),
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view(view, x, y, w, h): a rectangle for each order over an image of 4000 x 3000."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("view"),
        (F.col("o_orderkey") * 37 % 3600).cast("int").alias("x"),
        (F.col("o_custkey") * 53 % 2700).cast("int").alias("y"),
        (F.col("o_orderkey") % 900 + 100).cast("int").alias("w"),
        (F.col("o_custkey") % 700 + 50).cast("int").alias("h"),
    )


def resident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """have(level, column, row, bytes, used): tiles that are there, with the stamp of their last use."""
    line = table(spark, sf_dir, "lineitem")
    level = (F.col("l_linenumber") - 1) % 3
    side = lambda n: F.expr(f"int(ceil({n} / power(2, (l_linenumber - 1) % 3)))")
    tiles = line.groupBy(
        level.cast("int").alias("level"), (F.col("l_partkey") % side(16)).cast("int").alias("column"), (F.col("l_suppkey") % side(12)).cast("int").alias("row")
    ).agg(F.max((F.col("l_extendedprice")).cast("long")).alias("bytes"), F.max("l_orderkey").alias("used"))
    # every line counts; which tiles are there is a matter of their places
    return tiles.where("(column * 7 + row * 3 + level) % 5 < 3")
