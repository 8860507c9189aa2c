"""Tagged text that was taken for a running head or foot, given back to the body.

runs: doc, page, run, text, role, y, size, block (the tagged paragraph that a run belongs to; null outside the tree). y grows
upwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc", "page"]
# Fixed values of the format: the next line is at most so many sizes down, and a size is at least ten points.
NEXT_LINE, LEAST_SIZE = 1.6, 10.0


def reclaimed(runs: DataFrame) -> DataFrame:
    """The runs with their roles, head and foot runs of tagged paragraphs being body where they belong to the page's text.

    Where any head or foot of the page is outside the tree, all tagged ones are body. Elsewhere one is when its paragraph holds
    body text, or body text stands on the line above; what is given back counts as body for those further down, so it is
    judged from the top of the page down (equal heights by run). The nearest body line above and the paragraphs with
    body text are found by windows; only a page's tagged heads and feet are folded, with the last two heights and the
    paragraphs given back as state. Blank or null texts stay as they are, and so do runs without a height.
    """
    c = F.col
    band = c("role").isin("header", "footer") & (F.length(F.trim("text")) > 0)
    tagged = c("block").isNotNull()
    is_body = F.coalesce((c("role") == "body") & tagged, F.lit(False))
    page = Window.partitionBy(*PAGE)
    # of equal heights the body comes last, so that all body lines before a run lie strictly above it
    before = page.orderBy(F.desc("y"), "_body", "run").rowsBetween(Window.unboundedPreceding, -1)
    seen = runs.select(*PAGE, "run", "y", "size", "block", F.coalesce(band, F.lit(False)).alias("_band"), is_body.alias("_body"))
    seen = seen.withColumn("_above", F.min(F.when(c("_body"), c("y"))).over(before))
    seen = seen.withColumn("_open", F.bool_or(c("_band") & ~tagged).over(page)).withColumn("_with_body", F.bool_or("_body").over(Window.partitionBy(*PAGE, "block")))
    reach = NEXT_LINE * F.greatest(F.coalesce("size", F.lit(0.0)), F.lit(LEAST_SIZE))
    seed = c("_open") | c("_with_body") | F.coalesce(c("_above") - c("y") <= reach, F.lit(False))
    rows = F.struct((-c("y")).alias("down"), "run", "y", "block", reach.alias("reach"), seed.alias("seed"))
    heads = seen.where(c("_band") & tagged & c("y").isNotNull()).groupBy(*PAGE).agg(F.sort_array(F.collect_list(rows)).alias("_heads"))
    run, block = (runs.schema[k].dataType.simpleString() for k in ("run", "block"))
    start = F.expr(f"named_struct('last', double(null), 'upper', double(null), 'blocks', cast(array() as array<{block}>), 'taken', cast(array() as array<{run}>))")

    def step(s, r):
        above = F.when(s["last"] > r["y"], s["last"]).otherwise(s["upper"])
        ok = r["seed"] | F.coalesce(above - r["y"] <= r["reach"], F.lit(False)) | F.array_contains(s["blocks"], r["block"])
        lower = s["last"].isNull() | (s["last"] > r["y"])
        return F.when(
            ok,
            F.struct(
                r["y"].cast("double").alias("last"), F.when(lower, s["last"]).otherwise(s["upper"]).alias("upper"),
                F.array_union(s["blocks"], F.array(r["block"])).alias("blocks"), F.array_append(s["taken"], r["run"]).alias("taken"),
            ),
        ).otherwise(s)

    taken = heads.select(*PAGE, F.aggregate("_heads", start, step)["taken"].alias("_taken"))
    role = F.when(F.coalesce(F.array_contains("_taken", c("run")), F.lit(False)), "body").otherwise(c("role"))
    return runs.join(taken, PAGE, "left").withColumn("role", role).drop("_taken")
