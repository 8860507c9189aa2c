"""Ruled tables, page roles, footnotes, marks, residue and fidelity on hand-made pages and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import fidelity as V
from foliospark.operators import footnotes as N
from foliospark.operators import page_roles as R
from foliospark.operators import residue as P
from foliospark.operators import ruled_tables as T
from foliospark.operators.marked_content import marks_in_force
from foliospark.session import ship

RULE = "page long, rule long, x double, y double, width double, height double"
TEXT = "page long, line long, cell int, x double, right double, baseline double"


def table_rules(page, missing=(), broken=False):
    """Two rows and two columns between x 100, 200, 300 and y 700, 680, 660; the top in two pieces that nearly touch."""
    level = {0: (100, 700, 99, 1), 1: (200, 701, 100, 1), 2: (100, 680, 200, 1), 3: (100, 660, 200, 1)}
    upright = {4: (100, 660, 1, 40), 5: (200, 660, 1, 30 if broken else 40), 6: (300, 660, 1, 40)}
    lone = {7: (100, 600, 150, 1), 8: (400, 600, 50, 50)}  # an underline and a panel
    return [(page, k, *map(float, v)) for k, v in (level | upright | lone).items() if k not in missing]


def tables(spark, rules, text, frame=(100.0, 300.0)):
    pages = sorted({r[0] for r in rules})
    frames = spark.createDataFrame([(p, *frame) for p in pages], "page long, left double, right double")
    found = T.ruled_tables(spark.createDataFrame(rules, RULE), spark.createDataFrame(text, TEXT), frames, ["page"]).collect()
    return {(r["page"], r["r"], r["c"]): (r["above"], r["below"], r["before"], r["behind"], r["lines"]) for r in found}


def test_ruled_tables(spark):
    words = [(1, 0, 104.0, 140.0, 690.0), (1, 1, 204.0, 240.0, 690.0), (2, 0, 104.0, 201.5, 670.0), (3, 0, 104.0, 140.0, 650.0)]
    text = [(p, *w) for p in range(1, 8) for w in words]
    text += [(3, 4, 0, 150.0, 250.0, 672.0), (4, 5, 0, 104.0, 140.0, 668.0), (4, 5, 1, 310.0, 340.0, 668.0)]
    rules = table_rules(1) + table_rules(2, missing=(6,)) + table_rules(3) + table_rules(4) + table_rules(5, broken=True)
    rules += table_rules(6, missing=(2,)) + [(7, *r[1:3], *r[3:]) for r in table_rules(7)]
    got = tables(spark, rules, text)
    # line 3 stands below; line 2 reaches over the edge by less than the slack
    assert {k: v for k, v in got.items() if k[0] == 1} == {
        (1, 0, 0): (True, True, True, True, [1]), (1, 0, 1): (True, True, True, True, [1]),
        (1, 1, 0): (True, True, True, True, [2]), (1, 1, 1): (True, True, True, True, []),
    }
    assert got[2, 0, 1] == (True, True, True, False, [1])  # its right side isn't drawn
    assert {k[0] for k in got} == {1, 2, 7}  # text across a column, a line half outside, a short upright, two row edges
    assert tables(spark, table_rules(1), text, frame=(100.0, 270.0)) == {}  # too far out of the frame
    assert tables(spark, table_rules(1), [t for t in text if t[1] == 3]) == {}  # no text in it


def test_drawings_join_by_way_of_others(spark):
    rules = [(1, 5, 0.0, 0.0, 10.0, 1.0), (1, 3, 30.0, 0.0, 10.0, 1.0), (1, 9, 11.0, 0.0, 18.0, 1.0), (1, 2, 100.0, 0.0, 5.0, 1.0), (2, 1, 0.0, 0.0, 1.0, 1.0)]
    got = T.drawings(spark.createDataFrame(rules, RULE), ["page"]).collect()
    assert {(r["page"], r["rule"]): r["drawing"] for r in got} == {(1, 5): 3, (1, 3): 3, (1, 9): 3, (1, 2): 2, (2, 1): 1}


ITEM = "doc string, page long, item long, text string, x double, y double, width double, height double, page_width double, page_height double"


def items(spark, rows):
    return spark.createDataFrame([(*map(lambda v: float(v) if isinstance(v, float) else v, r), 612.0, 792.0) for r in rows], ITEM)


def column(doc, page, first, n, x, top, pitch, start=1):
    return [(doc, page, first + k, str(start + k), x, top - pitch * k, 10.0, 8.0) for k in range(n)]


def test_four_up_sheet(spark):
    """Four stacks make four small pages; their printed numbers decide the reading order, and bands are off."""
    rows = []
    for q, (x, top, printed) in enumerate([(20.0, 740.0, 44), (20.0, 350.0, 45), (330.0, 740.0, 42), (330.0, 350.0, 43)]):
        rows += column("d", 1, 100 * q, 6, x, top, 20.0)
        rows += [("d", 1, 100 * q + 50, f"Page {printed}", x + 200, top + 15, 30.0, 8.0), ("d", 1, 100 * q + 60, "Q. testimony", x + 30, top, 90.0, 8.0)]
    got = R.classified(items(spark, rows)).collect()
    assert {(r["printed"], r["confidence"], r["multi_up"]) for r in got} == {(42, "high", True)}
    roles = {r["item"]: r["role"] for r in got}
    assert all(roles[100 * q + k] == "line-number" for q in range(4) for k in range(6))
    assert [roles[100 * q + 50] for q in range(4)] == ["page-number"] * 4 and [roles[100 * q + 60] for q in range(4)] == ["body"] * 4


def test_pleading_pages(spark):
    """28 lines a page: the last one is no page number, what is below it is footer, heads repeat, stamps are told."""
    rows = []
    for page in range(1, 5):
        rows += column("d", page, 100, 28, 50.0, 730.0, 24.0)
        rows += [
            ("d", page, 1, f"CASE NO. {page}", 200.0, 740.0, 90.0, 8.0), ("d", page, 2, "BODY", 90.0, 82.0, 50.0, 8.0), ("d", page, 3, "TITLE OF IT", 200.0, 60.0, 90.0, 8.0),
            ("d", page, 4, f"- {page} -", 300.0, 30.0, 20.0, 8.0), ("d", page, 5, f"ABC{page:06d}", 480.0, 20.0, 60.0, 8.0), ("d", page, 6, f"only here {'x' * page}", 200.0, 728.0, 90.0, 8.0),
        ]
    got = R.classified(items(spark, rows)).collect()
    roles = {(r["page"], r["item"]): r["role"] for r in got}
    for page in range(1, 5):
        assert [roles[page, k] for k in (1, 2, 3, 4, 5, 6)] == ["header", "body", "footer", "page-number", "stamp", "body"]
        assert all(roles[page, 100 + k] == "line-number" for k in range(28))
    assert {(r["page"], r["printed"], r["confidence"]) for r in got} == {(p, p, "high") for p in range(1, 5)}


def test_two_stacks_are_one_page(spark):
    rows = column("d", 1, 100, 6, 20.0, 740.0, 20.0) + column("d", 1, 200, 6, 20.0, 350.0, 20.0) + column("d", 1, 300, 4, 300.0, 740.0, 20.0)
    got = R.classified(items(spark, rows)).collect()
    assert {r["multi_up"] for r in got} == {False}
    assert {r["item"] // 100: r["role"] for r in got} == {1: "line-number", 2: "line-number", 3: "body"}


PARAGRAPH = "doc string, page long, paragraph long, kind string, first double, bottom double, size double, leading double, hidden boolean, column int"


def noted(spark, pages):
    """pages: (page, notes as their numbers or None, marks in the text above, settings)."""
    paragraphs, marks, lines, rules = [], [], [], []
    for page, notes, above, change in pages:
        body = [700.0, 680.0, 660.0]
        rows = [*((y, 12.0) for y in body), *((600.0 - 12 * k, 9.0) for k in range(len(notes)))]
        for k, (y, size) in enumerate(rows):
            paragraphs.append(("d", page, k + 1, "text", y, y - 2, size, 11.0, change.get("hidden", False) and k >= 3, 2 if change.get("columns") and k == 0 else 1))
            lines.append(("d", page, y, 72.0, 400.0))
        marks += [("d", page, 4 + k, 1, n) for k, n in enumerate(notes) if n is not None] + [("d", page, 1 + k % 3, 2 + k, n) for k, n in enumerate(above)]
        rules.append(("d", page, 1, 72.0, change.get("y", 612.0), change.get("width", 144.0), 0.5))
        rules += [("d", page, 2, 300.0, 612.0, 144.0, 0.5)] if change.get("two") else []
    made = [
        (rules, "doc string, page long, rule int, x double, y double, width double, height double"), (paragraphs, PARAGRAPH),
        (marks, "doc string, page long, paragraph long, run int, number long"), (lines, "doc string, page long, baseline double, x double, right double"),
    ]
    return N.lifted(N.pairings(N.noted_pages(*[spark.createDataFrame(r, s) for r, s in made])))


@pytest.mark.parametrize(
    "notes,above,change,sound",
    [
        ([1, 2], [1, 2], {}, True), ([1, None, 2], [2, 1, 7], {}, True), ([1, 2], [1], {}, False), ([1, 2], [1, 2, 2], {}, False), ([1, 3], [1, 3], {}, False),
        ([1], [1], {"hidden": True}, False), ([1], [1], {"columns": True}, False), ([1], [1], {"width": 300.0}, None), ([1], [1], {"two": True}, None),
        ([None, 1], [1], {}, None), ([1], [1], {"y": 659.0}, None), ([1], [1], {"y": 640.0}, None),
    ],
)
def test_footnotes_of_a_page(spark, notes, above, change, sound):
    """Missing and doubled marks and gaps keep a page's notes; a rule that is too wide, not alone, an underline, too far up or over no
    note is no separator."""
    got = noted(spark, [(1, notes, above, change)]).collect()
    assert [r["sound"] for r in got] == ([] if sound is None else [sound])


def test_footnotes_stop_for_good(spark):
    """Numbers run on from page to page; the first page that fails keeps its notes, and so do all behind it."""
    pages = [(1, [1, None, 2], [1, 2], {}), (3, [3], [3], {}), (4, [5], [5], {}), (6, [4], [4], {})]
    found = noted(spark, pages)
    assert {r["page"]: r["kind"] for r in found.collect()} == {1: "lifted", 3: "lifted", 4: "kept", 6: "kept"}
    notes = {(r["page"], r["number"]): (r["paragraphs"], r["mark_paragraph"], r["mark_run"]) for r in N.footnotes(found).collect()}
    assert notes == {(1, 1): ([4, 5], 1, 2), (1, 2): ([6], 2, 3), (3, 3): ([4], 1, 2)}


def test_marks_equal_a_stack(spark):
    """Any mixture of begins, with and without ids, ends and texts, also ends of nothing and begins left open."""
    rng = random.Random(3)
    rows, want = [], {}
    for page in range(40):
        stack = []
        for k in range(rng.choice([0, 5, 60, 400])):
            kind = rng.choices(["begin", "end", "text"], [3, rng.choice([2, 3, 4]), 2])[0]
            mark = f"m{k}" if kind == "begin" and rng.random() < 0.6 else None
            rows.append((page, k, kind, mark, "clash"))
            if kind == "begin":
                stack.append(mark)
            elif kind == "end":
                stack = stack[:-1]
            else:
                want[page, k] = next((m for m in reversed(stack) if m), None)
    items = spark.createDataFrame(rows, "page long, k long, kind string, id string, other string")
    got = marks_in_force(items, ["page"], "k").collect()
    assert {(r["page"], r["k"]): r["mark"] for r in got} == want and len(got) == len(want)


def test_marks_of_a_long_page(spark):
    """A page of a megabyte of tags, in one pass."""
    n = 60_000
    k = F.col("id")
    kind = F.when(k % 3 == 0, "begin").when(k % 3 == 1, "text").otherwise(F.when(k < n // 2, "text").otherwise("end"))
    page = spark.range(n).select(F.lit(1).alias("page"), k.alias("k"), kind.alias("kind"), F.when(k % 6 == 0, k.cast("string")).alias("id"))
    got = marks_in_force(page, ["page"], "k").agg(F.count(F.lit(1)).alias("n"), F.count("mark").alias("marked")).first()
    assert got["n"] == got["marked"] == page.where("kind = 'text'").count()


def test_residue_in_every_form(spark):
    """A term left behind in any encoding is found, and only the file that keeps it fails."""
    term = "Smith é😀"
    forms = P.stored_forms(term)
    assert forms == ["smith é😀", "536d69746820e93d00", "0053006d0069007400680020 00e9d83dde00".replace(" ", "")]
    hidden = ["nothing", f"x {term.upper()} y", f"<{forms[1].upper()}>", f"<feff0041{forms[2]}0042>", ""]
    before = spark.createDataFrame([(k, f"{term} and {term}; {h}") for k, h in enumerate(hidden)], "file long, text string")
    after = spark.createDataFrame([(k, f"#### and ####; {h}") for k, h in enumerate(hidden)], "file long, text string")
    marked = spark.createDataFrame([(k, term.lower(), 2 + (k > 0 and h != "")) for k, h in enumerate(hidden)], "file long, term string, hits long")
    got = {r["file"]: tuple(r)[1:] for r in P.verdicts(P.proofs(before, after, marked, ["file"], [term, "absent", ""]), ["file"]).collect()}
    assert got == {0: (2, []), 1: (2, [term.lower()]), 2: (2, [term.lower()]), 3: (2, [term.lower()]), 4: (2, [])}
    assert spark.createDataFrame([(term,)], "t string").select(P.latin1_hex(F.col("t")), P.utf16_hex(F.col("t"))).first() == (forms[1], forms[2])


def subsequence(a, b):
    """Longest common subsequence by the plain table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert V.common_subsequence(a, b) == subsequence(a, b)


def test_fidelity(spark):
    """Every fact of the report, by hand: words lost, added and moved, a whole page shifted, numbers gone and off their lines."""
    ship(spark)
    schema = "page long, word long, text string, x double, y double, right double, page_width double"

    def page(p, rows):
        return [(p, k, t, x, y, x + 6.0 * len(t), 612.0) for k, (t, x, y) in enumerate(rows)]

    source = page(1, [("1", 40.0, 700.0), ("“Hello”", 90.0, 700.0), ("big", 130.0, 700.0), ("world", 160.0, 700.0), ("2", 40.0, 680.0), ("12", 90.0, 680.0), ("3", 40.0, 660.0)])
    export = page(1, [("1", 40.0, 702.0), ('"Hello"', 90.0, 702.0), ("world", 160.0, 702.0), ("new", 190.0, 702.0), ("2", 40.0, 681.0), ("2", 40.0, 600.0), ("12", 90.0, 690.0)])
    source += page(2, [("alone", 90.0, 700.0)])
    got = {r["page"]: r.asDict() for r in V.compared(spark.createDataFrame(source, schema), spark.createDataFrame(export, schema), ["page"]).collect()}
    # "12" stands left of the margin's share too, so it is a number as well: it moved by 10
    assert got[1] == {
        "page": 1, "source_words": 3, "exported_words": 3, "matched": 2, "missing": 1, "extra": 1, "median_dy": 2.0, "p95_dy": 2.0, "max_dy": 2.0, "shift_dy": 2.0,
        "numbers": 4, "off_lines": 3, "off_paper": 4,
    }
    assert (got[2]["source_words"], got[2]["exported_words"], got[2]["matched"], got[2]["missing"], got[2]["median_dy"], got[2]["numbers"]) == (1, 0, 0, 1, 0.0, 0)


def chains_of(sightings, step):
    """Greedy chains by the plain loop."""
    chains = []
    for band, lo, hi in sorted(sightings):
        centre = (lo + hi) / 2
        home = next((c for c in chains if 0 < band - c[-1][0] <= 4 and abs(centre - (c[-1][1] + c[-1][2]) / 2) <= step * (band - c[-1][0])), None)
        if home is None:
            chains.append([(band, lo, hi)])
        else:
            home.append((band, lo, hi))
    out = []
    for c in chains:
        if len(c) >= 0.7 * (c[-1][0] - c[0][0] + 1):
            thick, centre = (sorted(v)[len(c) // 2] for v in ([hi - lo for _, lo, hi in c], [(lo + hi) / 2 for _, lo, hi in c]))
            out.append((c[0][0], c[-1][0], len(c), centre - thick / 2, thick))
    return sorted(out)


def test_tracked_rules(spark):
    """Chains with gaps, crossings, ties and noise; slanted strokes; a gap of four bands ends one."""
    rng = random.Random(9)
    pages = {0: [(b, 10.0 + b, 12.0 + b) for b in range(12) if b not in (4, 5)], 1: [(b, 50.0, 53.0) for b in (0, 1, 2, 7, 8, 9)], 2: [(3, 5.0, 6.0)] * 3}
    for p in range(3, 20):
        pages[p] = [(rng.randrange(15), float(x), float(x + rng.randrange(1, 4))) for x in (rng.choice([10, 11, 13, 40, 60]) for _ in range(rng.randrange(40)))]
    rows = [(p, *s) for p, own in pages.items() for s in own]
    got = P_rules(spark, rows)
    assert got == {p: chains_of(own, 2.0) for p, own in pages.items() if chains_of(own, 2.0)}
    assert got[0] == [(0, 11, 10, 17.0, 2.0)] and len(got[1]) == 2


def P_rules(spark, rows):
    from foliospark.operators import pictures

    found = {}
    for r in pictures.tracked_rules(spark.createDataFrame(rows, "page long, band long, lo double, hi double"), ["page"], 2.0).collect():
        found.setdefault(r["page"], []).append((r["first_band"], r["last_band"], r["seen"], r["at"], r["thick"]))
    return {p: sorted(v) for p, v in found.items()}


def test_planned_pictures(spark):
    from foliospark.operators import pictures

    boxes = [
        (1, 1, 0.0, 0.0, 600.0, 780.0), (1, 2, 72.0, 100.0, 3.0, 50.0),  # a scan under hidden text, a speck
        (2, 1, 0.0, 0.0, 600.0, 780.0), (2, 2, 100.0, 500.0, 50.0, 50.0), (2, 3, 440.0, 100.0, 100.0, 50.0), (2, 4, 256.0, 100.0, 100.0, 50.0),
        (2, 5, 90.0, 100.0, 100.0, 50.0), (2, 6, 60.0, 100.0, 936.0, 50.0), (3, 1, 0.0, 0.0, 600.0, 780.0), *((4, k, 72.0, 100.0 + k, 10.0, 10.0) for k in range(13)),
    ]
    made = spark.createDataFrame(boxes, "page long, picture long, x double, y double, width double, height double")
    runs = spark.createDataFrame([(1, 300.0, "seen by a machine", True), (2, 520.0, "a line", False), (2, 149.0, "just touches", False), (2, 120.0, "  ", False)], "page long, y double, text string, hidden boolean")
    pages = spark.createDataFrame([(p, 612.0, 792.0, 72.0, 540.0) for p in range(1, 5)], "page long, page_width double, page_height double, left double, right double")
    got = {(r["page"], r["picture"]): (r["plan"], r["alignment"], r["indent"], r["plan_width"], r["plan_height"]) for r in pictures.planned_pictures(made, runs, pages, ["page"]).collect()}
    none = (None, None, None, None)
    assert got[1, 1] == ("scan", *none) and got[1, 2] == ("small", *none) and got[2, 1] == ("backdrop", *none)
    assert got[2, 2] == ("pinned", "left", 0.0, 50.0, 50.0)
    assert got[2, 3] == ("inline", "right", 0.0, 100.0, 50.0) and got[2, 4] == ("inline", "center", 0.0, 100.0, 50.0)
    assert got[2, 5] == ("inline", "left", 18.0, 100.0, 50.0) and got[2, 6] == ("inline", "left", 0.0, 468.0, 25.0)
    assert got[3, 1][0] == "inline" and {got[4, k][0] for k in range(13)} == {"many"}
    assert pictures.planned_pictures(made, runs, pages, ["page"], scans="behind").where("plan = 'behind'").count() == 1


def test_running_heads(spark):
    from foliospark.operators.running_heads import page_bands, running_heads

    rows = []
    for section, numbers in (("steady", ["- 4 -", "- 5 -", "- 6 -"]), ("first", [None, "Page 2 of 9", "Page 3 of 9"]), ("mixed", ["1", "[2]", "7"]), ("none", [None, None])):
        for page, number in enumerate(numbers, 1):
            rows += [(section, page, 10, "Smith v. Jones", 200.0, 760.0, "header", None), (section, page, 11, "left", 72.0, 750.0, "header", None)] if page > 1 else []
            rows += [(section, page, 20, " My  foot", 72.0, 40.0, "footer", None), (section, page, 30, "body", 72.0, 400.0, "body", None)]
            rows += [(section, page, 40, number, 300.0, 40.0, "page-number", None)] if number else []
    printed = {("steady", p): p + 3 for p in (1, 2, 3)} | {("first", p): p for p in (2, 3)} | {("mixed", 1): 1, ("mixed", 2): 2, ("mixed", 3): 7}
    rows = [(*r[:7], printed.get((r[0], r[1]))) for r in rows]
    items = spark.createDataFrame(rows, "doc string, page long, item long, text string, x double, y double, role string, printed int")
    got = {r["doc"]: tuple(r)[1:] for r in running_heads(page_bands(items, ["doc"]), ["doc"]).collect()}
    head = (2, "Smith v. Jones | left")
    assert got == {
        "steady": (3, *head, 1, "- {n} -", 4, True, False, None), "first": (3, *head, 2, "Page {n} of {total}", 1, True, True, 2),
        "mixed": (3, *head, 1, "{n}", 1, False, False, None), "none": (2, *head, None, None, None, False, False, None),
    }


def test_name_tree(spark):
    """A chain of 40 nodes, a cycle, a node with two parents, names that stand twice, targets that are no page."""
    from foliospark.operators.name_tree import destinations

    kids = [("d", f"n{k}", 0, f"n{k + 1}") for k in range(40)] + [("d", "n0", 1, "b"), ("d", "b", 0, "x"), ("d", "n0", 2, "x"), ("d", "y", 0, "z"), ("d", "z", 0, "y"), ("d", "x", 0, "b")]
    names = [("d", f"n{k}", 0, f"deep {k}", k) for k in range(41)] + [("d", "x", 1, "twice", 90), ("d", "b", 3, "twice", 91), ("d", "y", 0, "cycle", 92), ("d", "n0", 5, "no page", 999), ("e", "n0", 0, "other", 1)]
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    asked = [("d", f"deep {k}") for k in range(41)] + [("d", n) for n in ("twice", "cycle", "no page", "absent", "other")]
    got = destinations(
        made(asked, "doc string, name string"), made(names, "doc string, node string, ordinal int, name string, target long"), made(kids, "doc string, node string, ordinal int, kid string"),
        made([("d", "n0")], "doc string, node string"), made([("d", k, 1000 + k) for k in range(100)], "doc string, target long, page int"), ["doc"],
    )
    got = {r["name"]: r["page"] for r in got.collect()}
    assert got == {f"deep {k}": 1000 + k if k <= 32 else 1 for k in range(41)} | {"twice": 1091, "cycle": 1, "no page": 1, "absent": 1, "other": 1}


def scan(words, page=1, doc="a"):
    return [(doc, page, k, *w) for k, w in enumerate(words)]


SCAN = "doc string, page int, run long, text string, role string, hidden boolean, x double, y double, width double, size double"


def test_recognised_text(spark):
    from foliospark.functions.times import OTHER, WIDTHS
    from foliospark.operators.recognised import recognised_text

    wide = lambda t, size: sum(WIDTHS[ord(ch) - 32] if 32 <= ord(ch) < 127 else OTHER for ch in t) / 1000 * size
    word = lambda t, y, size, typed=12.0, hidden=True, role="body", x=100.0: (t, role, hidden, x, y, wide(t, typed), size)
    # heights of ink, baselines at bottoms of ink: 12 lines of a plain word beside one with a descender
    inky = [w for k in range(12) for w in (word("shorter", 700.0 - 20 * k, 9.0), word("principal", 700.0 - 20 * k - 2.64, 11.0))]
    extra = [word("TITLE WORDS", 760.0, 14.0, typed=18.0), word("it,", 400.0, 5.0), word("1", 300.0, 6.0, role="line-number", x=60.0), word("l6", 280.0, 6.0, x=60.0)]
    extra += [word("12", 30.0, 7.0, role="page-number"), word("Declaration", 40.0, 7.0, typed=9.0, role="footer"), word("seen as typed", 200.0, 3.0, hidden=False), (None, "body", True, 100.0, 1.0, 1.0, 4.0)]
    brackets = [(")", "body", True, 300.0 + k % 2, 600.0 - 20 * k, 4.0, 8.0) for k in range(6)] + [(")", "body", True, 310.0, 100.0, 4.0, 8.0)]
    # true sizes: nothing moves, not even five brackets
    true = [word(t, 700.0 - 20 * k, 12.0) for k in range(15) for t in ("shorter", "principal")] + [b[:6] + (12.0,) for b in brackets[:5]]
    rows = scan(inky + extra + brackets) + scan(true, doc="b") + scan(inky[:10], doc="c")
    got = {(r["doc"], r["run"]): r for r in recognised_text(spark.createDataFrame(rows, SCAN).withColumn("n", F.lit(1))).collect()}
    assert len(got) == len(rows)
    n = len(inky)
    for k in range(n):
        assert (got["a", k]["size"], round(got["a", k]["y"], 6)) == (12.0, 700.0 - 20 * (k // 2))
    size = [got["a", n + k]["size"] for k in range(8)]
    # the median of 12 nines, 12 elevens and a fourteen is 11, so the page number becomes 7 * 12 / 11, to the half point
    assert size == [18.0, 12.0, 12.0, 12.0, 7.5, 9.0, 3.0, 12.0]
    assert round(got["a", n + 1]["y"] - 400.0, 6) == round(0.13 * 12, 6) and got["a", n + 6]["y"] == 200.0
    assert [k for k in range(len(rows)) if ("a", k) in got and got["a", k]["stray"]] == [n + 3]
    assert [got["a", n + 8 + k]["own_cell"] for k in range(7)] == [True] * 6 + [False]
    for (doc, k), r in got.items():
        if doc != "a":  # true sizes; too few words and pairs
            assert (r["size"], r["y"], r["own_cell"]) == next((w[9], w[7], False) for w in rows if w[0] == doc and w[2] == k)
    empty = recognised_text(spark.createDataFrame([], SCAN))
    assert empty.count() == 0 and {"own_cell", "stray"} < set(empty.columns)


def test_reclaimed_equals_the_fold(spark):
    from foliospark.operators.tagged_body import reclaimed

    random.seed(5)
    rows = []
    for page in range(120):
        for run in range(random.randrange(0, 14)):
            role = random.choice(["body", "footer", "header", "footer", "page-number"])
            block = None if random.random() < (0.25 if page % 4 == 0 else 0.0) else random.randrange(6)
            rows.append(("d", page, run, random.choice(["text", "text", "text", " ", None]), role, float(random.randrange(0, 80, 4)), random.choice([6.0, 9.0, 12.0, None]), block))

    def fold(page):
        blank = lambda r: not (r[3] or "").strip()
        body = [r for r in page if r[4] == "body" and r[7] is not None]
        bands = [r for r in page if r[4] in ("header", "footer") and not blank(r)]
        outside, gone = any(r[7] is None for r in bands), set()
        for r in sorted((r for r in bands if r[7] is not None), key=lambda r: (-r[5], r[2])):
            reach = 1.6 * max(r[6] or 0.0, 10.0)
            if outside or any(o[7] == r[7] or 0 < o[5] - r[5] <= reach for o in body):
                body.append(r)
                gone.add(r[2])
        return {(r[1], r[2]): "body" if r[2] in gone else r[4] for r in page}

    want = {}
    for page in range(120):
        want |= fold([r for r in rows if r[1] == page])
    schema = "doc string, page int, run long, text string, role string, y double, size double, block long"
    got = {(r["page"], r["run"]): r["role"] for r in reclaimed(spark.createDataFrame(rows, schema)).collect()}
    assert got == want
    assert sum(want[r[1], r[2]] != r[4] for r in rows) > 50


def test_order_statistics(spark):
    from foliospark.operators.recognised import order_statistics

    random.seed(9)
    rows = [(g, random.choice([1.0, 2.5, 2.501, -3.0, random.uniform(-5, 20)])) for g in "ab" * 200] + [("c", 7.0), ("d", None)]
    n = F.col("n")
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["low"], r["ninth"]) for r in order_statistics(df, ["g"], "v", {"low": F.floor((n - 1) / 2), "ninth": F.floor(n * 0.9)}).collect()}
    want = {}
    for g in "abc":
        values = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = (len(values), values[(len(values) - 1) // 2], values[int(len(values) * 0.9)])
    assert got == want


def test_meeting_equals_all_pairs(spark):
    from foliospark.operators import meeting as M

    random.seed(11)
    place = lambda: random.choice([random.uniform(-50, 700), float(random.randrange(0, 640, 64)), 1e12, -1e12, None])
    box = lambda: (random.randrange(3), place(), place(), random.choice([0.0, 1.0, 64.0, 300.0]), random.choice([0.5, 9.0, 200.0]))
    left, right = ([(i, *box()) for i in range(150)] for _ in range(2))
    a = spark.createDataFrame(left, "i long, page long, ax double, ay double, aw double, ah double")
    b = spark.createDataFrame(right, "j long, page long, bx double, by double, bw double, bh double")
    c = F.col
    axes = [((c("ax"), c("ax") + c("aw")), (c("bx"), c("bx") + c("bw")), 64.0), ((c("ay"), c("ay") + c("ah")), (c("by"), c("by") + c("bh")), 64.0)]
    got = sorted((r["i"], r["j"]) for r in M.meeting(a, b, ["page"], axes).collect())
    meets = lambda p, s, q, t: p <= q + t and q <= p + s
    sound = lambda r: r[2] is not None and r[3] is not None
    want = sorted((p[0], q[0]) for p in left for q in right if p[1] == q[1] and sound(p) and sound(q) and meets(p[2], p[4], q[2], q[4]) and meets(p[3], p[5], q[3], q[5]))
    assert got == want and len(want) > 50
    assert M.meeting(a.limit(0), b, ["page"], axes).count() == 0


def test_quads_of_a_hit_over_two_runs(spark):
    from foliospark.operators.meeting import quads

    runs = spark.createDataFrame([(1, 1, 0, 4, 10.0, 40.0), (1, 2, 4, 10, 50.0, 60.0), (1, 3, 10, 11, 110.0, 0.0), (2, 1, 0, 99, 0.0, 99.0)], "page int, run int, start long, end long, x double, width double")
    hits = spark.createDataFrame([(1, 1, 2, 6), (1, 2, 10, 11), (3, 1, 0, 2)], "page int, match int, match_start long, match_end long")
    got = sorted((r["match"], r["run"], r["from"], r["to"], r["quad_x"], r["quad_width"]) for r in quads(runs, hits, ["page"]).collect())
    assert got == [(1, 1, 2, 4, 30.0, 20.0), (1, 2, 0, 2, 50.0, 20.0), (2, 3, 0, 1, 110.0, 0.01)]


def test_nearest_box_is_judged_by_its_own_reach(spark):
    from foliospark.operators.meeting import nearest_boxes

    # a small box 9 away (out of its reach of 6), a large one 12 away (within its 18): the nearest decides
    boxes = [(1, 7, 100.0, 100.0, 10.0, 4.0, 4.0), (1, 8, 131.0, 100.0, 10.0, 12.0, 12.0)]
    points = [(1, 1, 119.0, 102.0), (1, 2, 121.0, 102.0), (1, 3, 105.0, 102.0), (1, 4, 500.0, 500.0), (2, 5, 105.0, 102.0)]
    found = nearest_boxes(spark.createDataFrame(points, "page int, point int, px double, py double"), spark.createDataFrame(boxes, "page int, box int, x double, y double, width double, height double, size double"), ["page"], 12.0)
    assert sorted((r["point"], r["box"], r["distance"]) for r in found.collect()) == [(1, None, None), (2, 8, 10.0), (3, 7, 0.0), (4, None, None), (5, None, None)]


def test_underlines_and_echoes(spark):
    from foliospark.operators import meeting as M

    rule = "page int, rule int, x double, y double, width double, height double"
    rules = spark.createDataFrame([(1, 1, 100.0, 699.0, 50.0, 0.5), (1, 2, 100.0, 599.0, 50.0, 0.5), (1, 3, 151.5, 590.0, 1.0, 20.0), (1, 4, 100.0, 499.0, 30.0, 0.5), (1, 5, 300.0, 400.0, 1.0, 7.0)], rule)
    left = M.underline_rules(rules, ["page"])
    assert sorted(r["rule"] for r in left.collect()) == [1, 4, 5]  # 2 meets the upright 3; 5 is a tick
    runs = spark.createDataFrame([(1, 1, 100.5, 700.0, 50.0, 12.0), (1, 2, 100.0, 600.0, 50.0, 12.0), (1, 3, 100.0, 500.0, 50.0, 12.0), (1, 4, 100.0, 703.0, 50.0, 12.0)], "page int, run int, x double, y double, width double, size double")
    assert [r["run"] for r in M.underlined(runs, left, ["page"]).collect()] == [1]
    drawn = spark.createDataFrame([(1, 1, 0.0, 10.0, 100.0, 1.0), (1, 2, 0.0, 20.0, 100.0, 1.0), (1, 3, 0.0, 30.0, 100.0, 1.0), (1, 4, 5.0, 0.0, 1.0, 100.0)], rule)
    seen = spark.createDataFrame([(1, 9, 50.0, 12.0, 200.0, 1.0), (1, 8, 51.0, 20.0, 200.0, 1.0), (1, 7, 0.0, 32.5, 100.0, 1.0), (1, 6, 5.0, 0.0, 100.0, 1.0)], rule)
    assert sorted(r["rule"] for r in M.without_echoes(drawn, seen, ["page"]).collect()) == [2, 3, 4]


def test_clearest_foot(spark):
    from foliospark.operators.clearest import clearest_feet

    rows = [("a", 1, "4856.9844-ioss.i", True, False), ("a", 2, "4856-9844-1055.1", True, True), ("a", 3, "4856-9844-1055.l", True, True), ("a", 4, "4856-9844-1055.1", True, True), ("a", 5, None, True, True)]
    rows += [("b", 1, "", True, False), ("b", 2, "same foot", True, True), ("b", 3, "same foot", True, True)]  # too few
    rows += [("c", k, "same foot", k != 2, True) for k in (1, 2, 3)]  # a printed one
    rows += [("d", k, "zz" if k == 1 else "the foot", True, False) for k in range(1, 30)]
    got = {r["doc"]: (r["feet"], r["best_page"], r["score"]) for r in clearest_feet(spark.createDataFrame(rows, "doc string, page int, text string, hidden boolean, numbered boolean")).collect()}

    def pairs(t):
        t = "".join(t.split()).upper()
        return {t[k : k + 2] for k in range(len(t) - 1)}

    dice = lambda a, b: 2 * len(pairs(a) & pairs(b)) / (len(pairs(a)) + len(pairs(b)))
    score = round(sum(dice(rows[1][2], r[2]) for r in rows[:4]), 9)
    assert got == {"a": (4, 2, score), "b": (2, 1, None), "c": (3, 1, None), "d": (12, 2, 11.0)}


def test_request_problems(spark):
    from foliospark.operators.requests import request_problems

    drafts = [(k, "t", "n", "n@a.org") for k in range(1, 9)]
    drafts[0], drafts[1], drafts[2] = (1, None, "n", "n@a.org"), (2, "t", " ", "bad"), (3, "t", "n", None)
    signers = [(5, 1, "x", "x@a.org"), (5, 2, "", "bad"), (6, 1, "x", "x@a"), (6, 2, None, "y"), (7, 1, "x", "x@a.org"), (7, 2, "y", " y@a.org "), (8, 1, "x", "x@a.org"), (1, 1, None, None)]
    fields = [(7, 1), (7, 1), (5, 1), (5, 2), (6, 1), (6, 2)]
    got = request_problems(*(spark.createDataFrame(r, s) for r, s in ((drafts, "request int, title string, requester string, email string"), (signers, "request int, signer int, name string, email string"), (fields, "request int, signer int"))))
    want = {1: ("title", None), 2: ("requester", None), 3: ("requester-email", None), 4: ("no-signer", None), 5: ("signer-name", 2), 6: ("signer-email", 1), 7: ("nothing-to-sign", 2), 8: ("no-field", None)}
    assert {r["request"]: (r["problem"], r["signer"]) for r in got.collect()} == want


def test_underlines_exchange_no_words(spark, sf_dir):
    """Words aren't exchanged: lines are, dealt out by page, and everything behind that stays where it is."""
    from foliospark.plans import registry

    plan = registry.queries()["jon22_underlined"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges)


def test_that_meet_is_brute_force(spark):
    from foliospark.operators import meeting as M

    rng = random.Random(5)
    boxes = lambda n: [(rng.choice([1, 2, None]), k, rng.uniform(-300, 300), rng.choice([0.0, 3.0, 90.0, -5.0]), rng.uniform(-1e7, 1e7) if k % 9 == 0 else rng.uniform(0, 40)) for k in range(n)]
    left, right = boxes(80), boxes(80)
    a, b = spark.createDataFrame(left, "p int, id int, x double, w double, y double"), spark.createDataFrame(right, "p int, rid int, rx double, rw double, ry double")
    c = F.col
    axes = [((c("x"), c("x") + c("w")), (c("rx"), c("rx") + c("rw")), 16.0), ((c("y") - 4, c("y")), (c("ry"), c("ry")), 8.0)]
    meets = lambda r, s: r[0] == s[0] and r[0] is not None and r[3] >= 0 and s[3] >= 0 and r[2] <= s[2] + s[3] and s[2] <= r[2] + r[3] and r[4] - 4 <= s[4] <= r[4]
    holds = lambda u: (c("x") <= u["rx"] + u["rw"]) & (u["rx"] <= c("x") + c("w")) & (u["ry"] <= c("y")) & (u["ry"] >= c("y") - 4)
    want = {r[1] for r in left if any(meets(r, s) for s in right)}
    assert 0 < len(want) < 80
    assert sorted(r["id"] for r in M.that_meet(a, b, ["p"], "id", axes, holds).collect()) == sorted(want)
    assert sorted(r["id"] for r in M.that_meet(a, b, ["p"], "id", axes, holds, without=True).collect()) == sorted({r[1] for r in left} - want)


def test_ruled_tables_exchange_no_spans(spark, sf_dir):
    """Spans are merged where their page is, without an exchange by edge."""
    from foliospark.plans import registry

    plan = registry.queries()["cmp7_ruled_tables"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "level" in x]


def test_common_subsequence_of_many_words_in_little_room():
    """A table of 20,000 words a side took 1.6 GB; rows that are made again give the same pairs."""
    rng = random.Random(7)
    for _ in range(100):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(40))] for _ in range(2))
        assert V.common_subsequence(a, b, room=0) == subsequence(a, b)
    a = [str(rng.randrange(500)) for _ in range(20_000)]
    b = [w for w in a if rng.randrange(20)]
    assert len(V.common_subsequence(a, b)) == len(b)


def test_fidelity_exchanges_no_words(spark, sf_dir):
    """Whole lines are dealt out by page once a side; words and what is counted of them stay where their page is."""
    from foliospark.plans.fidelity_queries import agg27_fidelity, agg27_word_differences

    exchanges = {q: q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS") for q in (agg27_fidelity, agg27_word_differences)}
    assert exchanges == {agg27_fidelity: 1, agg27_word_differences: 0}  # the one is of finished pages, a row each


def test_what_meets_on_a_page_exchanges_no_words(spark, sf_dir):
    """Joins by more than the page exchanged all words again; now whole lines are dealt out, once a side."""
    from foliospark.plans import registry

    for name in ("jon7_nearest", "jon8_nearest_boxes", "jon13_match_quads"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_NUM" in plan, name


def test_nearest_mark_may_be_five_runs_before_a_mark(spark, tmp_path):
    """A long run that is a mark lies farther from its own middle than from the mark before it, with blanks between."""
    import duckdb

    from foliospark.plans import registry

    spark.createDataFrame([(1, "a b c d e" + " " * 5 + "x" * 17 + " f", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in registry.queries()["jon7_nearest"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()["jon7_nearest"]).fetchall())
    assert [r[:4] for r in got] == [r[:4] for r in want] and (1, 1, 10, 5) in [r[:4] for r in got]


def test_drawings_of_many_pages_and_of_a_page_of_many_rules(spark):
    """Pages are taken together on numpy; the fold that took a rule at a time in the plan is gone."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 40):
        x, y = rng.uniform(0, 200, (2, 30, n))
        right, top = x + rng.uniform(0, 40, (30, n)), y + rng.choice([0.5, 30.0], (30, n))
        want = [T._chained(*page) for page in zip(x, y, right, top, strict=True)]
        assert (T._drawings(x, y, right, top) == np.array(want)).all()
        for p, first in enumerate(want):
            low = list(range(n))
            for _ in range(n):
                low = [min(low[j] for j in range(n) if all(a[p][i] - 2 <= b[p][j] and a[p][j] - 2 <= b[p][i] for a, b in ((x, right), (y, top)))) for i in range(n)]
            assert low == first.tolist()
    rules = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0)], RULE)
    assert "aggregate(" not in T.drawings(rules, ["page"])._jdf.queryExecution().optimizedPlan().toString()


def test_recognised_text_exchanges_no_words(spark, sf_dir):
    """Texts are dealt out by page once, for all that read words; before, words were exchanged for each window and join."""
    from foliospark.plans import registry

    found = registry.queries()["cmp6_recognised_text"](spark, sf_dir).groupBy("own_cell", "stray").count()
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x and "ReusedExchange" not in x]
    assert plan.count("ArrowEvalPython [units(coalesce(text") == 1 and len(dealt) <= 5  # the others: feet, folios, pages without text
    own = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x and "(doc#" in x and "page#" in x.split("ENSURE")[0] and "ReusedExchange" not in x]
    assert len(own) == 1  # a page's facts


def test_order_statistics_of_counted_rows(spark):
    from foliospark.operators.recognised import order_statistics

    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", 2.0, 2), ("a", None, 9), (None, 1.0, 5), ("b", -4.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    n = F.col("n")
    got = {tuple(r) for r in order_statistics(df, ["g"], "v", {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)}, times="k").collect()}
    assert got == {("a", 6, 1.0, 2.0), ("b", 1, -4.0, -4.0)}


def test_numbering_exchanges_rows_once(spark):
    """The window and the join behind it have one key; groups may be null."""
    from foliospark.operators.ordinals import numbered

    df = spark.createDataFrame([(g, k, "t" * k) for k in range(40) for g in ("a", None, "b")], "g string, k long, t string")
    assert {(r["g"], r["k"], r["ordinal"], r["t"]) for r in numbered(df, ["g"], "k").collect()} == {(g, k, k + 1, "t" * k) for k in range(40) for g in ("a", None, "b")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = numbered(df, ["g"], "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(_key") == 3  # the rows; sums of their ranges, before and behind a window


def test_grids_of_pages_taken_together(spark):
    """Pages with and without grids, in one batch and in batches of one page, against the cells of each page by hand; no window by edge is left."""
    from foliospark.operators.ruled_tables import MOST_ROWS

    rules = [r for p in range(1, 6) for r in table_rules(p, missing=(5,) if p == 2 else (1, 2) if p == 3 else ())]
    rules = [r for r in rules if r[0] != 4] + [(4, k, 0.0, 30.0 * k, 5.0, 1.0) for k in range(3)]  # page 4: ticks
    df = spark.createDataFrame(rules, RULE).coalesce(1)
    whole = {(r, c): (True, True, True, True) for r in range(2) for c in range(2)}
    got = {}
    for r in T.grid_cells(df, ["page"]).collect():
        got.setdefault(r["page"], {})[r["r"], r["c"]] = (r["above"], r["below"], r["before"], r["behind"])
    # without its middle edge page 2 has one column; page 3 lacks a row edge
    assert got == {1: whole, 5: whole} and MOST_ROWS > len(rules)
    assert T.grid_cells(df.where("page = 4"), ["page"]).collect() == []
    text = spark.createDataFrame([(p, k, 0, 104.0, 140.0, y) for p in range(1, 6) for k, y in enumerate((690.0, None, 670.0, 650.0))], TEXT)
    assert sorted(tuple(r) for r in T.placements(df, text, ["page"]).collect()) == [(p, 0, line, 0, row, 0) for p in (1, 5) for line, row in ((0, 0), (2, 1))]
    for plan in (T.grid_cells(df, ["page"]), T.placements(df, text, ["page"])):
        assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()
