"""String functions on the traps that plain SQL functions fall into."""

import datetime

from pyspark.sql import functions as F

from foliospark.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_padding_never_cuts(spark):
    assert one(spark, lambda c: T.pad_number(c, 6), 1234567, "long") == "1234567"
    assert one(spark, lambda c: T.pad_number(c, 6), 42, "long") == "000042"


def test_halves_round_up(spark):
    assert one(spark, T.half_up, -2.5, "double") == -2
    assert one(spark, T.half_up, 2.5, "double") == 3


def test_strip_takes_no_break_spaces(spark):
    assert one(spark, T.strip, "  a b \n") == "a b"


def test_band_texts(spark):
    assert one(spark, T.band_text, "  Page  12 of 37 ") == "page ## of ##"
    assert one(spark, T.export_band_text, "Page 12 of 37") == "page#of#"


def test_printed_pages(spark):
    for value, want in (("Page 4 of 37", 4), ("Page4", 4), ("\u2013 4 \u2014", 4), ("(4) of 10", 4), ("- 4 -", 4), ("[4]", 4), ("4", 4), ("0", None), ("see 4", None), ("12345", None)):
        assert one(spark, T.printed_page, value) == want, value


def test_line_numbers(spark):
    assert [one(spark, T.line_number, v) for v in ("1", " 28 ", "29", "x")] == [1, 28, None, None]


def test_bates(spark):
    assert [one(spark, T.looks_like_bates, v) for v in ("ABC000123", "A-123", "1ABC123", "ABC 12")] == [True, True, False, False]


def test_fnv1a(spark):
    assert one(spark, T.fnv1a, "abc") == "7aigaz"


def test_roman_and_letters(spark):
    for n in range(1, 90):
        got = spark.range(1).select(T.roman_value(T.roman_numeral(F.lit(n)))).first()[0]
        assert got == n
    for n, want in ((1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")):
        assert spark.range(1).select(T.letters_of(F.lit(n).cast("long"))).first()[0] == want
        assert spark.range(1).select(T.value_of_letters(F.lit(want))).first()[0] == n


def test_dates(spark):
    day = datetime.date(2026, 3, 4)
    assert [one(spark, lambda c, s=s: T.date_stamp(c, s), day, "date") for s in [*T.DATE_FORMATS, "?"]] == [
        "03/04/2026", "04/03/2026", "2026-03-04", "March 4, 2026", "03/04/2026",
    ]


def test_natural_order(spark):
    names = ["p10", "p9", "P2", "p1b3", "p1b20"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n"))).collect()]
    assert got == ["p1b3", "p1b20", "P2", "p9", "p10"]


def test_entities_decode_once(spark):
    assert one(spark, T.decode_entities, "&amp;lt; &lt;b&gt; &unknown;") == "&lt; <b> &unknown;"
    assert one(spark, T.escape_html, '<a href="x">&\'') == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"


def test_citations(spark):
    def cite(*v):
        return spark.range(1).select(T.citation(*map(F.lit, v))).first()[0]

    assert cite(12, 3, 12, 3) == "(12:3)"
    assert cite(12, 5, 12, 3) == "(12:3-5)"
    assert cite(13, 1, 12, 3) == "(12:3-13:1)"


def test_colours_and_files(spark):
    assert tuple(one(spark, T.hex_colour, "#0fA")) == (0, 255, 170)
    assert one(spark, T.hex_colour, "#12345") is None
    assert one(spark, T.file_stem, "/a/b.c/report.final.PDF") == "report.final"
    assert one(spark, T.file_extension, "/a/b.c/report.PDF") == ".pdf"
    assert one(spark, T.file_extension, "/a/.profile") == ""


def test_word_starts(spark):
    texts = ["a bb  ccc", "", " ", "x ", " y", "é 𝄞 z", " ".join(["wörd", "𝄞x", "", "k"] * 50)]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.word_starts(F.col("t")).alias("w")).collect():
        assert r["w"] == [sum(len(w) + 1 for w in r["t"].split(" ")[:k]) for k in range(len(r["t"].split(" ")))]


def test_widths_are_looked_up_once(spark, sf_dir):
    """Against a plain sum, with nulls and wide characters; and no text is walked once for each class of width."""
    from foliospark.functions.times import OTHER, WIDTHS, times_units
    from foliospark.plans import registry

    texts = [None, "", "Ab 1~", "é𝄞\t\x7f", "", None, "x" * 1000]
    got = [tuple(r) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", times_units(F.col("t"))).collect()]
    plain = lambda t: sum(WIDTHS[ord(ch) - 32] if 32 <= ord(ch) <= 126 else OTHER for ch in t)
    assert sorted(got) == [(k, None if t is None else plain(t)) for k, t in enumerate(texts)]
    assert "translate(" not in registry.queries()["cmp6_recognised_text"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_widths_of_words_by_line(spark):
    from foliospark.functions.times import OTHER, WIDTHS, word_units

    plain = lambda t: sum(WIDTHS[ord(ch) - 32] if 32 <= ord(ch) <= 126 else OTHER for ch in t)
    texts = ["", " ", "\n", "a", "ab c\nd", " a\n\n b ", "é𝄞 x\ny\t", "W" * 50 + "\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select("t", word_units(F.col("t")).alias("u")).collect()
    assert [r["u"] for r in rows] == [[[plain(w) for w in line.split(" ")] for line in r["t"].split("\n")] for r in rows]
