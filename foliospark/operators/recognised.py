"""Recognised text made ready to be set as type: sizes from widths, baselines from ink, columns of brackets, stray numbers.

runs: doc, page, run (in reading order), text, role, hidden, x, y, width, size. Hidden runs are those of a recogniser's layer.
y grows upwards; doc and page are not null. A column `units` (times_units() of the text) spares counting it, which Spark's
partitioning does not survive: runs with it that are dealt out by doc and page are not exchanged again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import times_units

# Fixed values of the format.
LETTERS, FOOT_LETTERS, LEAST_WORDS = 5, 8, 20
SPREAD, UNDERSIZED, LARGER = 1.12, 0.93, 1.2
LEAST_PAIRS, INK_DROP, BESIDE = 12, 0.1, 0.5
SAME_COLUMN, LEAST_COLUMN, SLACK = 3.0, 6, 2.0
#: Classes of characters that reach below the baseline, and how far in sizes; the first that a text holds counts.
DESCENTS = (("[gjpqy]", 0.22), (r"[()\[\]{}|/$@_]", 0.18), ("[,;]", 0.13))

PAGE = ["doc", "page"]


def half_point(size: Column) -> Column:
    return F.floor(size * 2 + 0.5) / 2


def descent(text: Column) -> Column:
    share = F.lit(0.0)
    for pattern, reach in reversed(DESCENTS):
        share = F.when(text.rlike(pattern), reach).otherwise(share)
    return share


def order_statistics(rows: DataFrame, group: list[str], value: str, places: dict[str, Column], times: str | None = None) -> DataFrame:
    """Per group `n` and, for each name, the element at a place (from 0, an expression of `n`) among the sorted values.

    Equal values of a group are one row with a count. Counts are summed up over buckets of a 64th of a point, of which a group
    has a bounded number; then only the values of the buckets that hold a place are looked at, so a document with most of all
    words is spread over tasks. Nulls are left out, of the group too. times: how many rows each one stands for.
    """
    counts = rows.groupBy(*group, value).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_c"))
    # what the join below would filter, said for both its sides, so that they read the same exchange
    counts = counts.where(" AND ".join(f"{g} IS NOT NULL" for g in (*group, value))).withColumn("_bucket", F.floor(F.col(value) * 64)).where("_bucket IS NOT NULL")
    every = Window.partitionBy(*group)
    so_far = every.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    buckets = counts.groupBy(*group, "_bucket").agg(F.sum("_c").alias("_b"))
    buckets = buckets.select("*", F.sum("_b").over(so_far).alias("_upto"), F.sum("_b").over(every).alias("n"))
    start = F.col("_upto") - F.col("_b")
    at = {name: F.when((place >= start) & (place < F.col("_upto")), place - start).alias(f"_at_{name}") for name, place in places.items()}
    held = buckets.select(*group, "_bucket", "n", *at.values()).where(F.coalesce(*[F.col(f"_at_{name}") for name in places]).isNotNull())
    inside = Window.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = counts.join(held, [*group, "_bucket"]).withColumn("_in", F.sum("_c").over(inside))
    holds = lambda name: (F.col(f"_at_{name}") < F.col("_in")) & (F.col(f"_at_{name}") >= F.col("_in") - F.col("_c"))
    return found.groupBy(*group).agg(F.max("n").alias("n"), *[F.max(F.when(holds(name), F.col(value))).alias(name) for name in places])


def _places() -> dict[str, Column]:
    n = F.col("n")
    return {
        "low": F.floor((n - 1) / 2), "high": F.floor(n / 2),
        "first": F.least(n - 1, F.floor(n * 0.1)), "ninth": F.least(n - 1, F.floor(n * 0.9)),
    }


def _recognised() -> Column:
    """The text of a run if it is a recognised one of the body. Not as a condition of its own: Spark would take that to where the texts
    are read, and each reader of them would have an exchange of its own."""
    return F.trim(F.when(F.col("hidden") & (F.col("role") == "body"), F.col("text")))


def _measured(runs: DataFrame) -> DataFrame:
    return runs if "units" in runs.columns else runs.withColumn("units", times_units(F.col("text")))


def _by_width() -> Column:
    return F.when(F.col("units") > 0, F.col("width") / (F.col("units") / 1000))


def type_sizes(runs: DataFrame) -> DataFrame:
    """(doc, n, read, body_size): recognised words of five letters or more, their median size, and the size, to the half
    point, that their widths say the document was typed in; null where the layer's sizes are type sizes or words are few.

    Sizes are heights of ink when their ninth decile is over 1.12 of their first, or when they run under 0.93 of what widths say.
    """
    c = F.col
    words = _measured(runs).where(F.length(_recognised()) >= LETTERS).select("doc", "size", _by_width().alias("by_width"))
    tall = words.select("doc", F.explode(F.array(F.struct(F.lit(0).alias("kind"), c("size").alias("value")), F.struct(F.lit(1).alias("kind"), c("by_width").alias("value")))).alias("m"))
    found = order_statistics(tall.select("doc", "m.kind", "m.value"), ["doc", "kind"], "value", _places())
    middle = (c("low") + c("high")) / 2
    at = lambda kind, x, name: F.max(F.when(c("kind") == kind, x)).alias(name)
    one = found.groupBy("doc").agg(at(0, c("n"), "n"), at(0, middle, "read"), at(1, middle, "typed"), at(0, c("first"), "first"), at(0, c("ninth"), "ninth"))
    inky = (c("ninth") > SPREAD * c("first")) | (c("read") < UNDERSIZED * c("typed"))
    return one.select("doc", "n", "read", F.when((c("n") >= LEAST_WORDS) & inky, half_point(c("typed"))).alias("body_size"))


def ink_baselines(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc, pairs, drop, ink): neighbours of which one has a descender and the other stands on the line, the median of how
    much lower the former lies, and whether that is a tenth of the size in twelve pairs or more. sizes: type_sizes()."""
    c = F.col
    w = Window.partitionBy(*PAGE).orderBy("run")
    words = runs.where(F.length(_recognised()) > 0)
    low, plain = c("text").rlike(DESCENTS[0][0]), descent(c("text")) == 0
    words = words.select(*PAGE, "run", "y", low.alias("low"), plain.alias("plain"))
    pairs = words.select("doc", (F.lead("y").over(w) - c("y")).alias("rise"), "low", "plain", F.lead("low").over(w).alias("next_low"), F.lead("plain").over(w).alias("next_plain"))
    drop = F.when(c("low") & c("next_plain"), c("rise")).when(c("next_low") & c("plain"), F.lit(0.0) - c("rise"))
    # equal drops of a document are counted before they meet its size
    pairs = pairs.select("doc", drop.alias("drop")).where("drop IS NOT NULL").groupBy("doc", "drop").agg(F.count(F.lit(1)).alias("pairs"))
    pairs = pairs.join(sizes.select("doc", F.coalesce("body_size", "read").alias("of")), "doc").where(F.abs("drop") <= BESIDE * c("of"))
    found = order_statistics(pairs, ["doc", "of"], "drop", {k: v for k, v in _places().items() if k in ("low", "high")}, times="pairs")
    middle = (c("low") + c("high")) / 2
    return found.select("doc", c("n").alias("pairs"), middle.alias("drop"), ((c("n") >= LEAST_PAIRS) & (middle >= INK_DROP * c("of"))).alias("ink"))


def recognised_text(runs: DataFrame) -> DataFrame:
    """The runs with size and y as typed, and two more columns: own_cell (a bracket of a column of six or more at one x down
    the page) and stray (left over from the column of line numbers).

    Documents whose sizes are heights of ink: line numbers and words take the body's size, words plainly larger and feet their
    own by width, short feet the layer's size raised as the body's was. Documents whose baselines are bottoms of ink: words
    with descenders, brackets or commas are lifted. Documents without recognised words of five letters keep what they have;
    columns of brackets are marked in all. Runs that aren't hidden keep size and y. One row a run; null texts are neither
    words nor brackets.
    """
    c = F.col
    measured = _measured(runs)
    sizes = type_sizes(measured).select("doc", "read", "body_size")
    facts = sizes.join(ink_baselines(measured, sizes), "doc", "left").select("doc", "read", "body_size", F.coalesce("ink", F.lit(False)).alias("ink"))
    text = F.coalesce("text", F.lit(""))
    hidden_body = F.coalesce(c("hidden") & (c("role") == "body"), F.lit(False))
    bracket = F.coalesce(_recognised().rlike(r"^[)\]}]$"), F.lit(False))
    # places of brackets are counted, and what is left is a few rows a page; these and the document's facts meet its runs as one row
    places = measured.select(*PAGE, F.when(bracket, c("x")).alias("_x"), F.when(c("role") == "line-number", c("x") + c("width")).alias("_end"))
    places = places.groupBy(*PAGE, "_x").agg(F.count(F.lit(1)).alias("_c"), F.max("_end").alias("_end"))
    marks = places.groupBy(*PAGE).agg(
        F.percentile("_x", 0.5, F.when(c("_x").isNull(), 0).otherwise(c("_c"))).alias("_at"),
        F.collect_list(F.when(c("_x").isNotNull(), F.struct("_x", "_c"))).alias("_xs"),
        F.max("_end").alias("_right"),
    )
    near = F.aggregate("_xs", F.lit(0).cast("long"), lambda n, x: n + F.when(F.abs(x["_x"] - c("_at")) <= SAME_COLUMN, x["_c"]).otherwise(0))
    marks = marks.select(*PAGE, "_at", "_right", (near >= LEAST_COLUMN).alias("_column")).join(facts, "doc", "left")
    marked = measured.join(marks.hint("shuffle_hash"), PAGE, "left")
    own = bracket & (F.abs(c("x") - c("_at")) <= SAME_COLUMN) & c("_column")
    marked = marked.withColumn("own_cell", F.coalesce(own, F.lit(False)))
    bare = F.trim(text).rlike("^[0-9]{1,2}$") & (c("x") + c("width") <= c("_right") + SLACK)
    stray = (c("role") == "body") & F.when(c("hidden"), c("x") < c("_right")).otherwise(bare)
    marked = marked.withColumn("stray", F.coalesce(stray, F.lit(False)))

    n, by_width = F.length(F.trim(text)), _by_width()
    body, inky = c("body_size"), c("body_size").isNotNull()
    own_size = F.when(n >= LETTERS, by_width).otherwise(body)
    word = F.when(own_size > LARGER * body, half_point(own_size)).otherwise(body)
    long = F.when(c("role") == "page-number", FOOT_LETTERS).otherwise(LETTERS)
    foot = F.when(n >= long, half_point(by_width)).otherwise(F.least(body, half_point(c("size") * F.greatest(F.lit(1.0), body / c("read")))))
    role = c("role")
    typed = F.when(role == "line-number", body).when(role.isin("footer", "page-number"), foot).when(role == "body", word)
    size = F.coalesce(F.when(c("hidden") & inky, typed), c("size"))
    lift = F.when(hidden_body & F.coalesce(c("ink"), F.lit(False)), descent(text) * c("_size")).otherwise(0.0)
    done = marked.withColumn("_size", size).withColumn("y", c("y") + lift).withColumn("size", c("_size"))
    return done.select(*runs.columns, "own_cell", "stray")
