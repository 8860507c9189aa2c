"""The five stages, each against a brute-force version of it on its own input."""

import hashlib
import os
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as X

import corpus_pipeline
from foliospark.llm.packing import pack
from foliospark.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    X.docs(spark).select(COLUMNS).write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Documents before the first stage and after each but the last."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out, base = [docs], tmp_path_factory.mktemp("steps")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"file://{base}/{name}")
        docs = spark.read.parquet(f"file://{base}/{name}")
        out.append(docs)
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "substring_dedup", "packing"]
    assert all(df.columns == COLUMNS for df in steps)


def test_language_stage_drops_texts_without_letters(steps):
    kept = dict(pairs(steps[1]))
    assert kept == {i: t for i, t in pairs(steps[0]) if any(c.isalpha() for c in t or "")}


def test_exact_stage(steps):
    want = {i for i, v in X.exact(pairs(steps[1])).items() if v[2]}
    assert {i for i, _ in pairs(steps[2])} == want


def test_near_stage(steps):
    before = pairs(steps[2])
    assert {i for i, _ in pairs(steps[3])} == {i for i, v in X.links(before).items() if v[1] == i}


def test_substring_stage(steps):
    before = pairs(steps[3])
    want = X.windows(before)
    after = dict(pairs(steps[4]))
    assert set(after) == {i for i, v in want.items() if v[1] == 0 or v[0] > v[1]}
    for i, text in before:
        if i not in after:
            continue
        assert hashlib.sha256(" ".join(X.words(after[i])).encode()).hexdigest() == want[i][2]
        if not want[i][1]:
            assert after[i] == text
    assert sum(v[1] for v in want.values()) > 0
    assert all(r["n_chars"] == len(r["text"]) for r in steps[4].collect() if want[r["doc_id"]][1])


def test_packing_stage_and_run(spark, folder, steps):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    by_doc = defaultdict(list)
    for p in pack(steps[4], tokenizer("word_bpe_49k.json"), keep_ids=True).collect():
        by_doc[p["doc_id"]].append(p)
    after = dict(pairs(steps[4]))
    assert set(by_doc) == set(after)
    for i, own in by_doc.items():
        assert [x for p in sorted(own, key=lambda p: p["start"]) for x in p["ids"]] == [*t.encode(after[i], add_special_tokens=False).ids, 2]
    ran = corpus_pipeline.run(spark, folder)
    totals = lambda df: {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert totals(ran) == {i: sum(p["length"] for p in own) for i, own in by_doc.items()}


def test_empty_input(spark, tmp_path):
    X.empty(spark).select(COLUMNS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


CLASHES = ["kept_text", "n_removed", "row_number", "cut_key", "starts", "c0", "component_id", "id", "first", "content_hash"]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Repeated rows, rows without an id, and columns named like those of the operators, in several files."""
    docs = X.awkward(spark).select(*COLUMNS, *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    more = [(None, "text without id", None, None, 3, *["x"] * len(CLASHES)), (None, X.rows()[4][1], None, None, None, *["y"] * len(CLASHES))]
    path = f"file://{tmp_path_factory.mktemp('awkward')}/documents.parquet"
    docs.union(spark.createDataFrame(more, docs.schema)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def counted(rows):
    return Counter(tuple(r) for r in rows)


def order(i):
    return (i is None, i)


def test_awkward_rows_language(spark, awkward):
    kept = corpus_pipeline.language_stage(spark, awkward, "").collect()
    assert counted(kept) == counted(r for r in awkward.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_nothing_learned_keeps_all(spark, awkward):
    nameless = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_stage(spark, nameless, "").count() == awkward.count()


def test_awkward_rows_exact(spark, awkward):
    """One row of each text: the longest one, then the one with the smallest id."""
    rows, kept = awkward.collect(), corpus_pipeline.exact_stage(spark, awkward, "")
    assert kept.columns == awkward.columns
    groups = defaultdict(list)
    for r in rows:
        groups["".join(X.words(r["text"]))].append(r)
    best = {k: min((-len(r["text"] or ""), order(r["doc_id"])) for r in own) for k, own in groups.items()}
    got = {"".join(X.words(r["text"])): (-len(r["text"] or ""), order(r["doc_id"])) for r in kept.collect()}
    assert got == best and kept.count() == len(groups)
    assert not counted(kept.collect()) - counted(rows)


def test_awkward_rows_near(spark, awkward):
    rows, kept = awkward.collect(), corpus_pipeline.near_stage(spark, awkward, "").collect()
    numbered = sorted(rows, key=lambda r: order(r["doc_id"]))
    found = X.links([(k, r["text"]) for k, r in enumerate(numbered)])
    want = [r for k, r in enumerate(numbered) if found[k][1] == k]
    assert counted(kept) == counted(want)


def test_awkward_rows_substring(spark, awkward):
    rows, kept = awkward.collect(), corpus_pipeline.substring_stage(spark, awkward, "")
    assert kept.columns == awkward.columns and kept.schema == awkward.schema
    ids, table = {}, []
    for r in sorted(rows, key=lambda r: order(r["doc_id"])):
        if r["doc_id"] not in ids:
            ids[r["doc_id"]] = len(table)
            table.append((len(table), r["text"]))
        elif r["doc_id"] is None:
            table.append((len(table), r["text"]))
    want = X.windows(table)
    hashes = {k: v[2] for k, v in want.items() if v[1] == 0 or v[0] > v[1]}
    got = kept.collect()
    sha = lambda r: hashlib.sha256(" ".join(X.words(r["text"])).encode()).hexdigest()
    known = [r for r in got if r["doc_id"] is not None]
    assert {(r["doc_id"], sha(r)) for r in known} == {(i, hashes[k]) for i, k in ids.items() if i is not None and k in hashes}
    assert Counter(r["doc_id"] for r in known) == Counter(r["doc_id"] for r in rows if ids.get(r["doc_id"]) in hashes and r["doc_id"] is not None)
    # those without an id come last: "text without id" twice and nothing; the passage of another document is cut away
    assert sorted(str(r["text"]) for r in got if r["doc_id"] is None) == ["None", "text without id", "text without id"]
    assert all(r["starts"] == f"starts-{r['doc_id']}" for r in known)


def test_awkward_rows_packing(spark, awkward):
    pieces = corpus_pipeline.packing_stage(spark, awkward, "").collect()
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(r["doc_id"] for r in awkward.collect())
