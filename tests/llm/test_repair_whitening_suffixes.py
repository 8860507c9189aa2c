"""Conversation repair, whitening and suffix dedup against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import heapq
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as X

from foliospark.llm import conversation_repair as repair_module
from foliospark.llm import suffix_dedup as suffixes
from foliospark.llm.conversation_repair import damage, repair
from foliospark.llm.queries import queries
from foliospark.llm.whitening import bit_planes, moments, whiten
from foliospark.session import ship

TURNS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def damaged(rows):
    by = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return by


def repaired(turns):
    """Cheapest repair by Dijkstra over (place, grammar state), costs and then audits in order."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in turns:
        rest = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("b" if not rest else "d" if (role, text) in seen else "k" if rest[-1] in ".!?" else "t")
        seen.add((role, text))
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, k, state, out = heapq.heappop(heap)
        if k == len(turns) and state in (0, 3):
            break
        if (k, state) in done:
            continue
        done.add((k, state))
        for role in ("user", "assistant"):
            if role[0] in step[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", k, step[state][role[0]], (*out, role + ":")))
        if k < len(turns):
            _, own, text = turns[k]
            late = faults[k] == "t"
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, state, out))
            if faults[k] in "kt":
                if own[:1] and own[0] in step[state]:
                    heapq.heappush(heap, (cost + late, audit + "K", k + 1, step[state][own[0]], (*out, f"{own}:{text}")))
                for role in ("user", "assistant"):
                    if role[0] in step[state]:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", k + 1, step[state][role[0]], (*out, f"{role}:{text}")))
    counts = [faults.count(f) for f in "bdt"]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def odd_turns():
    """Nulls in every column, ties, repeated rows, odd roles, and conversations that never forget how they end."""
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.choice([0, 1, 2, 5, 9, 30])):
            for _ in range(rng.choice([1, 1, 1, 2])):
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
                text = rng.choice(["Hi there.", "ok", "  ", "What?\n", None, f"é!{rng.random()}", str(rng.random())])
                rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    rows += [(conv, 0, "user", "Alone.") for conv in range(1000, 1060)]
    rows += [(77, t, "user", f"all user {t}.") for t in range(150)] + [(78, t, "user", "again and again.") for t in range(80)]
    return rows + [(79, t, "ua"[t % 2] + "x", f"q{t}.") for t in range(101)] + [(80, 0, "user", "long " * 100_000)]


@pytest.mark.parametrize("limits", [{}, {"chunk_rows": 3, "first_run": 2}, {"chunk_rows": 1, "first_run": 1}, {"chunk_bytes": 40}])
def test_repair(spark, limits):
    rows = odd_turns()
    want = {conv: repaired(turns) for conv, turns in damaged(rows).items()}
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())
    got = repair(damage(spark.createDataFrame(rows, TURNS).repartition(3)), **limits).collect()
    assert len(got) == len(want)
    assert {r[0]: tuple(r)[1:] for r in got} == want


def test_repair_of_the_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries()["op11_conversation_repair"](spark, sf_dir).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {conv: repaired(turns) for conv, turns in damaged(rows).items()}
    assert sum(r["cost"] for r in got) > 0


def test_repair_of_no_turns_and_other_columns(spark):
    assert repair(damage(spark.createDataFrame([], TURNS))).collect() == []
    more = spark.createDataFrame([(1, 0, "user", "Hi.", "x", "y")], f"{TURNS}, key string, part string")
    assert [r["conv_id"] for r in repair(damage(more)).collect()] == [1]


def test_sweeps_meet():
    """Another start vector gives what the whole run gives, also where vectors never meet."""
    rng = random.Random(1)
    starts = [repair_module.END, (0, 0, 0, 0), (2, 2, 2, 0), (2, 2, 0, 2)]
    for symbols in [bytes([1] * 31), bytes([8] * 20), *[bytes(rng.choices(range(9), k=40)) for _ in range(30)]]:
        for a in starts:
            for b in starts:
                assert repair_module.sweep_again(symbols, a, repair_module.sweep(symbols, a), b) == repair_module.sweep(symbols, b)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, component int")


def test_whitening(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = [r[0] for r in table]
    x = np.floor(256 * np.array([r[1] for r in table], dtype=float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, axes = e[::-1], axes[:, ::-1]
    want = (x - s / n) @ axes[:, :4] / np.sqrt(e[:4])
    got = queries()["op12_whitening"](spark, sf_dir).collect()
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter((i, c) for i in ids for c in range(1, 5))
    place = {i: k for k, i in enumerate(ids)}
    signs = {}
    for r in got:
        k, c = place[r["vec_id"]], r["component"]
        assert r["n"] == n and r["deviation"] == int(((n * x[k] - s) ** 2).sum())
        assert r["explained"] == pytest.approx(e[c - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
        signs.setdefault(c, np.sign(r["whitened"] * want[k, c - 1]))
        assert r["whitened"] * signs[c] == pytest.approx(want[k, c - 1], abs=1e-8)


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, float("nan")]), (None, [-3.0, 2.5]), (2, None), (3, [1.0, None]), (4, [0.5, float("inf")]), (5, [1.0]), (6, [])]
    got = whiten(vectors(spark, [(*r, "clash", 7) for r in rows])).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 4, None: 2}
    assert {r["n"] for r in got} == {2}
    first = [r["whitened"] for r in got if r["component"] == 1]
    assert [abs(v) for v in first] == pytest.approx([1.0] * 3)
    assert {r["whitened"] for r in got if r["component"] == 2} == {None}  # two points lie on a line
    same = whiten(vectors(spark, [(1, [1.0, 2.0], "", 1), (2, [1.0, 2.0], "", 1)])).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, 0.0, None)}
    assert whiten(vectors(spark, [])).collect() == []
    assert whiten(vectors(spark, [(1, None, "", 1)])).collect() == []


def test_moments_are_exact(spark):
    """Also of entries near the limits of a long, and over more rows than a block's words."""
    rng = random.Random(3)
    x = [[rng.choice([-(2**63), 2**63 - 1, -1, 0, 5]), rng.randrange(-1000, 1000), 7] for _ in range(150)]
    n, sums, cross = moments(spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(2), 3)
    assert n == 150
    assert sums == [sum(v[a] for v in x) for a in range(3)]
    assert cross == [[sum(v[a] * v[b] for v in x) for b in range(3)] for a in range(3)]


def test_bit_planes():
    x = np.array([[3, -2], [0, 5], [1, -2]] * 30, dtype=np.int64)
    planes = bit_planes(x, [0, -2], [2, 3])
    assert planes.shape == (6, 2)
    assert int(np.bitwise_count(planes[0] & planes[5]).sum()) == 60  # odd entries of the first dimension


def without_repeats(rows, width=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + width] for _, t in texts for k in range(len(t) - width + 1))
    out = Counter()
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out[i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeats():
    """Passages of 199 and 200 bytes and longer, edited copies, a line in many surroundings, periodic texts, nulls, repeats."""
    rng = random.Random(2)

    def prose(n):
        return "".join(rng.choice("abcdefghij äß") for _ in range(n))

    exact, short, longer, line = prose(200), "".join(rng.choice("abc") for _ in range(199)), prose(230), prose(120)
    rows = [(k, prose(300) + exact + prose(rng.randrange(500))) for k in range(5)]
    rows += [(k + 10, prose(100) + short + prose(100)) for k in range(4)]
    rows += [(k + 20, prose(150) + longer + prose(50) + longer[:210]) for k in range(4)]
    rows += [(None, None), (1, ""), (1, "x" * 199), (2, "x" * 200), (2, "y" * 201), (None, "z" * 1000), (3, prose(900))]
    rows += [rows[0], rows[5], rows[-1], (50, "ab" * 3000), (51, "abc" * 500 + prose(100) + "abc" * 200)]
    base = prose(3000)
    for k in range(20):
        own = list(base)
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = rng.choice("XYZ")
        rows.append((100 + k, "".join(own)))
    rows += [(200 + k, prose(300) + line + prose(300)) for k in range(40)]
    return rows + [(300 + k, prose(300) + exact[:190] + prose(300)) for k in range(30)]


@pytest.mark.parametrize("limits", [suffixes.Limits(), suffixes.Limits(sorted=3, sent=2, anchors=50, size=2000, windows=100)])
def test_suffix_dedup(spark, limits):
    rows = repeats()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(3)
    want = without_repeats(rows)
    assert Counter(tuple(r) for r in suffixes.suffix_digests(docs, limits=limits).collect()) == want
    for r in suffixes.suffix_dedup(docs, limits=limits).collect():
        digest = hashlib.sha256(bytes(r["kept"])).hexdigest()
        assert want[r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), digest]


def test_suffix_dedup_of_the_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in queries()["op13_suffix_dedup"](spark, sf_dir).collect())
    assert got == without_repeats(rows)
    assert sum(r[2] for r in got) > 0


def test_suffix_dedup_of_awkward_rows(spark):
    docs = X.awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert Counter(tuple(r) for r in suffixes.suffix_digests(docs).collect()) == without_repeats(rows)
    assert suffixes.suffix_digests(X.empty(spark)).collect() == []


def test_suffix_dedup_of_long_texts(spark):
    """Texts of more than one piece: their common part goes, wherever pieces begin."""
    rng = np.random.default_rng(1)
    same = rng.integers(97, 123, 1_500_000, dtype=np.uint8).tobytes().decode()
    docs = spark.createDataFrame([(1, same), (2, "another beginning" + same + "!")], "doc_id long, text string")
    got = {r[0]: tuple(r)[1:4] for r in suffixes.suffix_digests(docs).collect()}
    assert got == {1: (1_500_000, 1_500_000, 1), 2: (1_500_018, 1_500_000, 1)}


def test_suffix_order_mends_collisions(monkeypatch):
    """Whatever the prefix hashes say, the order and the equal neighbours are those of the bytes."""
    rng = np.random.default_rng(7)
    raw = rng.integers(97, 99, 4000, dtype=np.uint8)
    x = np.sort(rng.choice(3900, 600, replace=False))
    group = np.repeat(np.arange(3), 200)
    for broken in (False, True):
        if broken:  # every byte hashes alike
            monkeypatch.setattr(suffixes, "_BYTES", np.ones(256, np.uint64))
        order, equal = suffixes.suffix_order(raw, x, group, 12)
        got = [raw[p : p + 12].tobytes() for p in x[order].tolist()]
        assert (group[order] == group).all()
        for g in range(3):
            assert got[200 * g : 200 * g + 200] == sorted(got[200 * g : 200 * g + 200])
        assert equal.tolist() == [k % 200 > 0 and got[k] == got[k - 1] for k in range(600)]
