"""Pictures on a page, by their boxes alone: drawn rules tracked over a scan's bands, and what becomes of each picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format.
MOST_GAP, SEEN_SHARE = 3, 0.7
LEAST_SIDE, MANY, FULL_SHARE = 4.0, 12, 0.6
OVERLAP, UNDERLAP, EDGE = 2.0, 1.0, 6.0


def _middle(values: Column) -> Column:
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def tracked_rules(sightings: DataFrame, key: list[str], step: float) -> DataFrame:
    """(key, rule, first_band, last_band, seen, at, thick): strokes that go through bands of a scan.

    sightings: key, band, lo, hi: thin inked stretches across a band. In order of band and place, each joins the first chain whose
    last sighting lies up to MOST_GAP bands off and whose centre it keeps within `step` a band; else it begins a chain. A chain
    takes one sighting a band. Those seen in SEEN_SHARE of their bands are rules. A page's chains are folded as an array.
    """
    page = sightings.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("band", "lo", "hi"))).alias("all"))
    kind = "array<struct<first:bigint,last:bigint,centre:double,centres:array<double>,sizes:array<double>>>"

    def fold(chains: Column, s: Column) -> Column:
        band, centre, size = s["band"].cast("bigint"), (s["lo"] + s["hi"]) / 2.0, (s["hi"] - s["lo"]).cast("double")
        gap = lambda c: band - c["last"]
        near = lambda c: (gap(c) > 0) & (gap(c) <= MOST_GAP + 1) & (F.abs(centre - c["centre"]) <= step * gap(c))
        home = F.get(F.filter(F.transform(chains, lambda c, k: F.when(near(c), k)), lambda k: k.isNotNull()), 0)

        def chain(first: Column, centres: Column, sizes: Column) -> Column:
            return F.struct(first.alias("first"), band.alias("last"), centre.alias("centre"), centres.alias("centres"), sizes.alias("sizes"))

        longer = lambda c: chain(c["first"], F.concat(c["centres"], F.array(centre)), F.concat(c["sizes"], F.array(size)))
        grown = F.transform(chains, lambda c, k: F.when(k == home, longer(c)).otherwise(c))
        return F.when(home.isNull(), F.concat(chains, F.array(chain(band, F.array(centre), F.array(size))))).otherwise(grown).cast(kind)

    chains = page.select(*key, F.posexplode(F.aggregate("all", F.array().cast(kind), fold)).alias("k", "c"))
    seen, thick = F.size("c.centres"), _middle(F.col("c.sizes"))
    whole = chains.where(seen >= SEEN_SHARE * (F.col("c.last") - F.col("c.first") + 1))
    return whole.select(
        *key, (F.col("k") + 1).cast("long").alias("rule"), F.col("c.first").alias("first_band"), F.col("c.last").alias("last_band"), seen.cast("long").alias("seen"),
        (_middle(F.col("c.centres")) - thick / 2).alias("at"), thick.alias("thick"),
    )


def planned_pictures(pictures: DataFrame, runs: DataFrame, pages: DataFrame, key: list[str], scans: str = "omit") -> DataFrame:
    """Adds to each picture: plan, alignment, indent, plan_width, plan_height.

    pictures: key, picture, x, y, width, height. runs: key, y, text, hidden: the body's runs. pages: key, page_width, page_height,
    left, right (of the text's frame). plan: 'small' (below LEAST_SIDE, left out), 'many' (one of more than MANY, left out),
    'scan' (a full page over hidden text: left out, or 'behind' if scans says so), 'backdrop' (a full page under text, left out),
    'pinned' (over lines of visible text, at its own size) or 'inline' (fitted to the frame, aligned by the gaps at its sides).
    """
    c = F.col
    body = runs.where(F.trim("text") != "")
    facts = body.groupBy(*key).agg(F.bool_or("hidden").alias("hidden_text"), F.lit(True).alias("any_text"))
    sized = pictures.join(pages, key).join(facts, key, "left")
    large = (c("width") >= LEAST_SIDE) & (c("height") >= LEAST_SIDE)
    n = F.count_if(large).over(Window.partitionBy(*key))
    area = c("page_width") * c("page_height")
    full = (area > 0) & (c("width") * c("height") >= FULL_SHARE * area)
    # visible lines that a picture lies over: an equi-join by page with the band as condition
    lines = body.where(~c("hidden")).select(*[c(k).alias(f"run_{k}") for k in key], c("y").alias("run_y")).distinct()
    same = [c(k) == c(f"run_{k}") for k in key]
    over = pictures.join(lines, [*same, c("run_y") >= c("y") - UNDERLAP, c("run_y") <= c("y") + c("height") - OVERLAP], "left_semi")
    sized = sized.withColumn("n", n).join(over.select(*key, "picture", F.lit(True).alias("over")).distinct(), [*key, "picture"], "left")
    plan = (
        F.when(c("n") > MANY, F.when(large, "many").otherwise("small")).when(~large, "small")
        .when(full & F.coalesce("hidden_text", F.lit(False)), "behind" if scans == "behind" else "scan")
        .when(full & F.coalesce("any_text", F.lit(False)), "backdrop").when(c("over"), "pinned").otherwise("inline")
    )
    found = sized.withColumn("plan", plan)
    scale = F.least(F.lit(1.0), F.greatest(F.lit(1.0), c("right") - c("left")) / c("width"))
    wide = F.when(c("plan") == "inline", c("width") * scale).when(c("plan") == "pinned", c("width")).when(c("plan") == "behind", c("page_width"))
    high = F.when(c("plan") == "inline", c("height") * scale).when(c("plan") == "pinned", c("height")).when(c("plan") == "behind", c("page_height"))
    found = found.withColumn("plan_width", wide).withColumn("plan_height", high)
    before, behind = c("x") - c("left"), c("right") - (c("x") + c("plan_width"))
    right = (F.abs(behind) <= EDGE) & (before > EDGE)
    centred = (F.abs(before - behind) <= EDGE) & (before > EDGE)
    kept = c("plan").isin("inline", "pinned", "behind")
    alignment = F.when(c("plan") == "inline", F.when(right, "right").when(centred, "center").otherwise("left")).when(kept, "left")
    indent = F.when((c("plan") == "inline") & ~right & ~centred, F.greatest(F.lit(0.0), before)).when(kept, 0.0)
    return found.select(*pictures.columns, "plan", alignment.alias("alignment"), indent.alias("indent"), "plan_width", "plan_height")
