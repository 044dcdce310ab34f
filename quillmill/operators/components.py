"""Connected components by alternating large-star and small-star steps.

Each round sends every vertex's larger neighbours, then the smaller ones, to the least vertex known nearby; after about
log n rounds each component is a star around its least vertex. Edges stay distributed; each round is written to the
shared folder, so a lost executor costs one round. A hub's neighbours are reduced by a partial minimum before the
shuffle, and joins back to the minimum are merge joins that AQE may split: small as they can look, minima are never
broadcast, so that nothing of a round passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.plans.scratch import remove, scratch, written


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """vertex, component (its least vertex) for every vertex on an edge."""
    spark = edges.sparkSession
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    loops = both.where("u = v").select("u").distinct()
    e = both.where("u != v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).select("u", "v").distinct()
    e = written(e, path := scratch(spark, "edges"))
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    seen = e.agg(F.count(F.lit(1)), mark).first()
    if seen[0]:
        while True:
            sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # minima are written: dealt anew on both sides, the joins with them stay open to AQE's splitting of a hub
            low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            low = written(low, at := scratch(spark, "minima"))
            large = sym.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = written(large, at_large := scratch(spark, "edges"))
            least = written(large.groupBy("u").agg(F.min("v").alias("m")), at_least := scratch(spark, "minima"))
            joined = large.join(least.hint("merge"), "u")
            small = joined.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
            nxt = written(small.where("u != v").distinct(), new := scratch(spark, "edges"))
            now = nxt.agg(F.count(F.lit(1)), mark).first()
            for gone in (path, at, at_large, at_least):
                remove(spark, gone)
            e, path = nxt, new
            if now == seen:
                break
            seen = now
    stars = e.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("vertex")).unionByName(loops.select(F.col("u").alias("vertex"))).distinct()
    return stars.unionByName(roots.join(stars.hint("merge"), "vertex", "left_anti").select("vertex", F.col("vertex").alias("component")))
