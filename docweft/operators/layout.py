"""Page geometry: reading order in column bands, captions, overlapping boxes.

A page holds a bounded number of regions, so windows and joins within one page stay small; a hot document has many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where a left column ends and a right one begins, regions that a column needs, the gap of a caption.
LEFT_ENDS, RIGHT_BEGINS, COLUMN_REGIONS, CAPTION_GAP = 0.52, 0.48, 2, 0.08


def order_regions(regions: DataFrame) -> DataFrame:
    """``page, region_id, column, band, place`` (from 0) of ``regions(page, region_id, x0, y0, x1, y1)``.

    A page has two columns if two regions or more lie on each side of a gutter. Regions that cross it cut the page into bands, and
    each stands before its band; inside a band the left column comes before the right. Other pages are read by y, then x.
    """
    page = Window.partitionBy("page")
    left, right = F.col("x1") <= LEFT_ENDS, F.col("x0") >= RIGHT_BEGINS
    gutter = F.max(F.when(left, F.col("x1"))).over(page) <= F.min(F.when(right, F.col("x0"))).over(page)
    two = (F.count_if(left).over(page) >= COLUMN_REGIONS) & (F.count_if(right).over(page) >= COLUMN_REGIONS) & gutter
    sided = regions.withColumn("_two", F.coalesce(two, F.lit(False))).withColumn("column", F.when(F.col("_two"), F.when(left, 0).when(right, 1)))
    read = page.orderBy("y0", "x0", "region_id")
    banded = sided.withColumn("band", F.when(F.col("_two"), F.count_if(F.col("column").isNull()).over(read)).otherwise(0))
    place = F.row_number().over(page.orderBy("band", F.asc_nulls_first("column"), "y0", "x0", "region_id")) - 1
    return banded.select("page", "region_id", "column", F.col("band").cast("long").alias("band"), place.cast("long").alias("place"))


def caption_link(regions: DataFrame) -> DataFrame:
    """``region_id, figure``: the figure or table of the page that a caption shares some width with and is nearest to, above or below."""
    side = lambda kinds, p: regions.where(F.col("kind").isin(kinds)).select("page", *[F.col(k).alias(p + k) for k in ("region_id", "x0", "y0", "x1", "y1")])
    gap = F.round(F.least(F.abs(F.col("a_y0") - F.col("b_y1")), F.abs(F.col("b_y0") - F.col("a_y1"))), 9)
    met = side(["caption"], "a_").join(side(["figure", "table"], "b_"), "page").withColumn("_gap", gap)
    near = met.where((F.least("a_x1", "b_x1") > F.greatest("a_x0", "b_x0")) & (F.col("_gap") <= CAPTION_GAP))
    return near.groupBy(F.col("a_region_id").alias("region_id")).agg(F.min(F.struct("_gap", "b_region_id")).alias("_m")).select("region_id", F.col("_m.b_region_id").alias("figure"))


def spatial_regions(regions: DataFrame, question: Column, terms: Column, spatial: Column, most: int = 4) -> DataFrame:
    """``page, region_id, value``: the regions of each page that serve the question best, three for each shared word and one for a visual kind
    if the question is spatial; boxes must lie on the page. ``terms`` are the words of ``question``; ``words`` is a column of regions."""
    inside = F.col("x0").between(0, 1) & F.col("x1").between(0, 1) & F.col("y0").between(0, 1) & F.col("y1").between(0, 1) & (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    shared = F.size(F.array_intersect(terms, F.col("words")))
    visual = (F.col("kind").isin("figure", "table", "caption") & spatial).cast("int")
    valued = regions.where(inside & question.isNotNull()).withColumn("value", (3 * shared + visual).cast("long")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("value"), "region_id"))
    return valued.withColumn("_r", rank).where(F.col("_r") <= most).select("page", "region_id", "value")
