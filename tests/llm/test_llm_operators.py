"""Each operator against a brute-force version, and on nulls, repeats, empty tables and clashing columns."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as X

from foliospark.llm import imatch, language_id, suffix_tree
from foliospark.llm.common import fold
from foliospark.llm.components import connected_components
from foliospark.llm.exact_dedup import exact_dedup
from foliospark.llm.kd_shards import kd_shards
from foliospark.llm.line_dedup import line_dedup
from foliospark.llm.ngram_join import block_product, ngram_join
from foliospark.llm.packing import pack
from foliospark.llm.queries import oracle_sql, queries, tokenizer
from foliospark.llm.sentence_pieces import PieceCodec, encode_pieces, piece_digests
from foliospark.llm.substring_dedup import kept_digests, substring_dedup, window_hashes
from foliospark.session import ship


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got, want = queries()[name](spark, sf_dir), con.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in got.select(want.columns).collect()) == Counter(want.fetchall())


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def table():
    return [(r[0], r[1]) for r in X.rows()]


def test_exact_dedup(spark):
    got = {r[0]: tuple(r)[1:] for r in exact_dedup(X.docs(spark)).collect()}
    assert got == X.exact(table())


def test_line_dedup(spark):
    for run, least in ((3, 20), (3, 1000), (2, 4), (4, 6), (1, 1000)):
        got = {r[0]: tuple(r)[1:] for r in line_dedup(X.docs(spark), run=run, words=least).collect()}
        assert got == X.lines(table(), run, least), (run, least)
        assert sum(v[2] for v in got.values()) > 0


def test_line_dedup_on_repeated_rows(spark):
    some = [r for r in X.awkward(spark).collect() if r[0] is not None]
    got = line_dedup(X.awkward(spark)).where("doc_id is not null").collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *X.lines(table(), 3, 20)[r[0]]) for r in some)


def test_line_dedup_takes_time_in_proportion_to_lines(spark):
    """A text of many lines, half of them in runs that occurred before: 200,000 lines take seconds."""
    own = [f"line {k} {k * k % 91}" for k in range(100_000)]
    text = "\n".join([x for k in range(0, 100_000, 10) for x in (*own[k : k + 10], f"gap {k}", *own[k : k + 10], f"other {k}")])
    r = line_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_lines"], r["n_removed"]) == (220_000, 100_000)
    assert r["kept_text"] == "\n".join([x for k in range(0, 100_000, 10) for x in (*own[k : k + 10], f"gap {k}", f"other {k}")])


def test_ngram_join(spark):
    got = {r[0]: tuple(r)[1:] for r in ngram_join(X.docs(spark)).collect()}
    assert got == X.links(table())
    assert sum(v[2] for v in got.values()) > 0


def test_ngram_join_over_several_blocks(spark, monkeypatch):
    from foliospark.llm import ngram_join as module

    monkeypatch.setattr(module, "BLOCK", 4)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(60):
        own = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 8))):
            own[at] = f"e{k}-{at}"
        rows.append((k, " ".join(own)))
    got = {r[0]: tuple(r)[1:] for r in module.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == X.links(rows)


def test_block_product_counts_links():
    sets = [np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    ids, sizes, weights = np.array([7, 3, 9]), np.array([10, 9, 10]), np.array([1, 2, 1])
    every = np.arange(3)
    least, weight, _ = block_product(ids, sizes, weights, sets, every, every, 80)
    assert least[:3].tolist() == [3, 3, 9]
    assert weight[:3].tolist() == [2, 1, 0]


def test_components(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 300), (5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100, 300: 100}


def test_substring_dedup(spark):
    want = X.windows(table())
    assert {r[0]: tuple(r)[1:] for r in kept_digests(X.docs(spark)).collect()} == want
    for r in substring_dedup(X.docs(spark)).collect():
        n, removed, sha = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"]) == (n, removed)
        assert hashlib.sha256(" ".join(X.words(r["kept_text"])).encode()).hexdigest() == sha
        assert sum(s["end"] - s["start"] for s in r["spans"]) == removed
        if not removed:
            assert r["kept_text"] == dict(table())[r["doc_id"]]


def test_window_hashes_differ_exactly_with_words():
    for size in (1, 3, 20):
        own = [f"w{k % 30}" for k in range(90)]
        both = window_hashes(" ".join(own).encode(), size)
        assert both.shape == (2, len(own) - size + 1) and len(set(both[1].tolist())) > 0.9 * len(set(both[0].tolist()))
        h = [tuple(x) for x in both.T.tolist()]
        keys = [tuple(own[k : k + size]) for k in range(len(own) - size + 1)]
        assert len(h) == len(keys)
        assert len(set(h)) == len(set(keys))
        assert all((a == b) == (x == y) for a, x in zip(h, keys, strict=True) for b, y in zip(h, keys, strict=True))


def test_substring_dedup_carries_columns(spark):
    docs = X.awkward(spark).withColumnsRenamed({"length": "kept_text", "component": "n_removed"})
    got = substring_dedup(docs, carry=("kept_text", "n_removed", "text")).collect()
    assert Counter((r["doc_id"], r["c2"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert {(r["c0"], r["c1"]) for r in got} <= {("clash", "clash"), (None, None)}


def test_exchange_keeps_keys_apart_that_agree_in_one_hash(spark):
    """Keys of two hashes, all of which share the first one: found equal by both only."""
    import pyarrow as pa

    from foliospark.llm.packed import exchange

    def hashes(text):
        own = np.array([int(x) for x in text.split()], dtype=np.uint64)
        return np.stack([np.full_like(own, 7), own])

    def rows(new, doc):
        return [pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.ones(len(doc), np.int64))], ["doc_id", "n"])] if len(doc) else []

    def local(new, doc, place):
        return new, rows(new[~new], doc[~new])

    def judge(new, doc, place):
        return rows(new[~new], doc[~new])

    def combine(found):
        ids, n = np.unique(found.column(0).to_numpy(), return_counts=True)
        return pa.table({"doc_id": ids, "n": n})

    docs = spark.createDataFrame([(3, "1 2 3"), (1, "9 1 9"), (2, "3 2 8"), (4, "5")], "doc_id long, text string").repartition(2)
    schema = "doc_id long, n long"
    got = exchange(docs, 5, hashes, local, judge, schema, combine, schema).collect()
    # of two equal keys the later one counts, by chunk first: 9 in document 1; 1, 2 and 3 of two documents each
    assert sum(r["n"] for r in got) == 4


def test_pieces_match_the_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = dict(table())
    for r in encode_pieces(X.docs(spark), path).collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids
        assert r["decoded"] == lib.decode(ids)
    for r in piece_digests(X.docs(spark), path).collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_agendas_agree():
    codec = PieceCodec(tokenizer("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    signs = list("▁abcdeéß日😀\n<0x>")
    some = ["▁" + "".join(rng.choice(signs, int(rng.integers(1, 40)))) for _ in range(500)]
    assert codec.merge_many(some) == [codec._bytes(codec._long_agenda(list(w))) for w in some]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pieces = pack(X.docs(spark), path, window=256, keep_ids=True).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_window[p["sequence_id"]].append(p)
    for i, text in table():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda p: p["start"])
        assert [x for p in own for x in p["ids"]] == ids
        for p in own:
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert p["doc_tokens"] == len(ids)
    source = {r[0]: r[3] for r in X.rows()}
    total = sum(p["length"] for p in pieces)
    share = Counter()
    for p in pieces:
        share[source[p["doc_id"]]] += p["length"] / total
    assert sorted(by_window) == list(range(len(by_window)))
    for k, own in by_window.items():
        own = sorted(own, key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == list(np.cumsum([0, *[p["length"] for p in own]])[:-1])
        size = sum(p["length"] for p in own)
        assert size == 256 or k == len(by_window) - 1
        if size == 256:  # target proportions in each window, to a token for each queue
            mix = Counter()
            for p in own:
                mix[source[p["doc_id"]]] += p["length"]
            assert all(abs(mix[s] - 256 * share[s]) <= 2 for s in share if share[s] > 1 / 64)


def test_kd_shards(spark):
    got = kd_shards(X.docs(spark), n_shards=4).collect()
    sizes = {i: len((t or "").encode()) + 1 for i, t in table()}
    assert {r["doc_id"]: r["size"] for r in got} == sizes
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["text_crc32"] == zlib.crc32((dict(table())[r["doc_id"]] or "").encode())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("n", [1, 3, 8])
def test_kd_shards_are_near_equal(spark, sf_dir, n):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sums = [r[1] for r in kd_shards(docs, n_shards=n).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == n
    assert max(sums) - min(sums) <= 40_000


def test_kd_shards_by_target(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sums = [r[1] for r in kd_shards(docs, target_bytes=100_000).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sums) == -(-sum(sums) // 100_000)


def test_imatch(spark):
    some = sorted(((i, t or "") for i, t in table()), reverse=True)
    lexicon = imatch.lexicon(X.docs(spark))
    got = {r["doc_id"]: r for r in imatch.edited_fingerprints(X.docs(spark), lexicon).collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprints(X.docs(spark), lexicon).collect()}
    assert len(got) == len(some)
    for k, (i, t) in enumerate(some):
        following = some[(k + 1) % len(some)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[1][:half]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == prints[i]
        assert r["near_next"] == imatch.likeness(prints[i], prints[following[0]])
        assert 0 <= r["near_edited"] <= 1
    assert prints[1] == prints[4]


def test_imatch_tells_edits_from_strangers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    means = imatch.edited_fingerprints(docs, imatch.lexicon(docs)).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert means[0] > 0.15
    assert means[1] < 0.05


def test_suffix_tree_base_and_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = fold(F.col("doc_id"), 7) == 2
    tree, vocabulary = suffix_tree.train(docs.where(~held))
    got = suffix_tree.score(docs, tree, vocabulary).collect()
    n, want = X.unigrams([tuple(r) for r in docs.collect()], lambda i: X.fold(i, 7) == 2)
    for r in got:
        tokens, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base)
    unseen = [r for r in got if X.fold(r["doc_id"], 7) == 2]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_suffix_tree_scores(spark, sf_dir):
    """Scores of all documents equal those of a tree of plain dictionaries, with contexts of several lengths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    table = [tuple(r) for r in docs.collect()]
    want, lengths = X.tree_scores([t for i, t in table if X.fold(i, 7) != 2], table)
    assert max(lengths) >= 3
    got = suffix_tree.score(docs, *suffix_tree.train(docs.where(fold(F.col("doc_id"), 7) != 2))).collect()
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, rel=1e-9)


def test_suffix_tree_scores_awkward_rows(spark):
    docs = X.docs(spark)
    want, _ = X.tree_scores([t for i, t in table()], table())
    assert {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, *suffix_tree.train(docs)).collect()} == pytest.approx(want, rel=1e-9)


def test_suffix_tree_scores_every_row(spark):
    """Repeated rows and rows without an id, with equal and with other texts, each have their own score."""
    texts = ["a b c d", "a b c d", "b a", None, "a b c d", "zz"]
    ids = [1, 1, None, None, None, 1]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    train = spark.createDataFrame([(k, "a b c d b a") for k in range(30)], "doc_id long, text string")
    tree = suffix_tree.train(train)
    single = {t: suffix_tree.score(spark.createDataFrame([(5, t)], "doc_id long, text string"), *tree).first() for t in set(texts)}
    want = Counter((i, single[t]["n_tokens"], single[t]["n_known"], round(single[t]["base_score"], 6), round(single[t]["score"], 6)) for i, t in zip(ids, texts))
    got = suffix_tree.score(docs, *tree).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want


def test_packing_refuses_vocabularies_it_would_cut(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    from foliospark.llm.packing import token_bytes

    words = {w: k for k, w in enumerate(["<unk>", "left</w>", ",", ".", "right", "ends", "left", "Left", "RIGHT"])}
    for name, more, lower in (("wide", {f"w{k}": k for k in range(9, 70_000)}, True), ("cased", {}, False)):
        own = Tokenizer(models.WordLevel(words | more, unk_token="<unk>"))
        own.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
        if lower:
            own.normalizer = normalizers.Lowercase()
        own.save(str(tmp_path / f"{name}.json"))
        with pytest.raises(ValueError, match="16-bit" if name == "wide" else "lower-case"):
            token_bytes([b"left"], str(tmp_path / f"{name}.json"))


def test_suffix_tree_is_a_distribution(spark):
    """Over every known token and the unknown one, the probabilities after each context sum to 1."""
    text = " ".join(["a b c", "a b d", "x y", "z a b c"] * 50)
    docs = spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string")
    tree, vocabulary = suffix_tree.train(docs, common_share=0)
    assert any(len(level.keys) for level in tree.levels)
    every = np.arange(len(tree.words))
    counts = {r["word"]: r["c"] for r in vocabulary.collect()}
    assert len(counts) == len(tree.words)
    for level_at, level in enumerate(tree.levels):
        for s in range(len(level.keys)):
            states = [np.full(len(every), -1) for _ in tree.levels]
            states[level_at] = np.full(len(every), s)
            a, b = suffix_tree._conditional(tree, every, states)
            total = (a + b * tree.root(tree.counts)).sum() + level.rest[s] * tree.unknown
            assert total == pytest.approx(1)


def test_language_id_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held))
    got = language_id.identify(docs, model).join(docs, "doc_id").where(held)
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count()


def test_language_id_labels_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs)
    part = {r["lang"]: " ".join(r["text"].split()[:60]) for r in docs.where("length(text) > 2000").dropDuplicates(["lang"]).collect()}
    mixed = spark.createDataFrame([(1, part["de"] + " " + part["es"]), (2, "123 ² !"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(mixed, model).collect()}
    assert {s["lang"] for s in got[1]["spans"] if s["end"] - s["start"] > 20} == {"de", "es"}
    assert (got[2]["lang_pred"], got[3]["lang_pred"]) == ("und", "und")


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(5)
    sizes = np.array([1, 4, 3, 5])
    scores = rng.normal(size=(sizes.sum(), 3))
    got = language_id.viterbi(scores, sizes, 0.7)
    at = 0
    for n in sizes:
        part = scores[at : at + n]

        def value(p, part=part, n=n):
            return sum(part[k, p[k]] for k in range(n)) - 0.7 * sum(p[k] != p[k - 1] for k in range(1, n))

        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert value(got[at : at + n]) == pytest.approx(value(best))
        at += n


def every_operator(docs):
    held = fold(F.col("doc_id"), 7) == 2
    words = imatch.lexicon(docs)
    tree, vocabulary = suffix_tree.train(docs.where(~held))
    yield "pieces", piece_digests(docs, tokenizer("piece_bpe_32k.model"))
    yield "lines", line_dedup(docs)
    yield "ngrams", ngram_join(docs)
    yield "imatch", imatch.edited_fingerprints(docs, words)
    yield "shards", kd_shards(docs, n_shards=3)
    yield "substrings", substring_dedup(docs)
    yield "packing", pack(docs, tokenizer("word_bpe_49k.json"))
    yield "suffix tree", suffix_tree.score(docs, tree, vocabulary)
    yield "language", language_id.identify(docs, language_id.train(docs))
    yield "exact", exact_dedup(docs)


def test_empty_tables(spark):
    for name, df in every_operator(X.empty(spark)):
        assert df.collect() == [], name


def test_repeated_rows_and_null_ids(spark):
    docs = X.awkward(spark)
    n = docs.count()
    for name, df in every_operator(docs):
        rows = df.collect()
        ids = {r["doc_id"] for r in rows} - {None}
        assert ids == {r[0] for r in X.rows()}, name
        if name != "packing":
            assert len(rows) == n, name


def test_ngram_join_on_repeated_rows(spark):
    """Repeated rows, in one partition and in several, give what single ones give."""
    some = X.rows()
    want = X.links([(r[0], r[1]) for r in some])
    for parts in (1, 5):
        docs = spark.createDataFrame([*some, *some[:12], some[0]], X.SCHEMA).repartition(parts)
        got = ngram_join(docs).collect()
        assert len(got) == len(some) + 13
        assert {r[0]: tuple(r)[1:] for r in got} == want


def test_suffix_tree_keeps_contexts_at_any_size(spark):
    """A context is retained by its own count, however large the rest of the corpus, and also beyond two words."""
    phrase = "red green blue gold"
    filler = [" ".join(f"f{(k * 7919 + i * 104729) % 5003}" for i in range(2000)) for k in range(100)]
    others = [f"red blue{i % 5} green blue other{i % 7} green red" for i in range(40)]
    for more in ([], filler):
        texts = [f"{phrase} x{i % 9}" for i in range(25)] + others + more
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        tree, vocabulary = suffix_tree.train(docs)
        assert tree.depth >= 3
        asked = [(1, phrase), (2, "blue green red gold")]
        got = {r["doc_id"]: r["score"] for r in suffix_tree.score(spark.createDataFrame(asked, docs.schema), tree, vocabulary).collect()}
        assert got[1] > got[2] + 3, len(more)


@pytest.mark.parametrize("common_share", [1e-3, 1])
def test_suffix_tree_head_only_spares_a_join(spark, sf_dir, common_share):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0")
    want = {r[0]: r for r in suffix_tree.score(docs, *suffix_tree.train(docs, common_share=0)).collect()}
    got = {r[0]: r for r in suffix_tree.score(docs, *suffix_tree.train(docs, common_share=common_share)).collect()}
    assert len(got) == len(want)
    for i, r in got.items():
        assert (r["n_tokens"], r["n_known"]) == (want[i]["n_tokens"], want[i]["n_known"])
        assert (r["base_score"], r["score"]) == (pytest.approx(want[i]["base_score"]), pytest.approx(want[i]["score"]))


def test_suffix_tree_head_is_filled_up_to_a_number(spark, sf_dir, monkeypatch):
    """The head takes the most frequent entries up to a number, however small their share of all tokens is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id % 4 = 0")
    want = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, *suffix_tree.train(docs, common_share=0)).collect()}
    monkeypatch.setattr(suffix_tree, "HEAD_ENTRIES", 300)
    tree, vocabulary = suffix_tree.train(docs)
    sizes = [len(tree.words), *(len(level.keys) + len(level.pairs) for level in tree.levels)]
    assert max(sizes) <= 300 and sizes[0] > 150
    assert {r["doc_id"]: r["score"] for r in suffix_tree.score(docs, tree, vocabulary).collect()} == pytest.approx(want)


def test_suffix_tree_tokens_of_a_chunk():
    """Words of many texts, cut and hashed together, are those of each text."""
    draw = random.Random(5)
    texts = [bytes(draw.choice(b" \t\n\x0b\x0c\r\x1c\x85\xc3\xa9aAbBzZ\x00") for _ in range(draw.randrange(300))) for _ in range(200)]
    texts += [b"", b" ", b"x" * 63, b"x" * 64, b"X" * 65, b"y" * 5000 + b" q", b"a\0 a a\0\0"]
    h, sizes = suffix_tree._tokens(iter(texts))
    words = [w for t in texts for w in [*t.lower().split(), None]]
    assert sizes.tolist() == [len(t.split()) + 1 for t in texts]
    assert len(h) == len(words) and (h == suffix_tree.END).tolist() == [w is None for w in words]
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words)))


def test_suffix_tree_sends_equal_pairs_of_a_task_once(spark):
    """Pairs of several chunks are counted together before they are exchanged, in less than half of what each chunk would send."""
    texts = [" ".join(f"w{(k * 31 + i * i) % 997}" for i in range(400)) for k in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).collect()
    batches = [pa.RecordBatch.from_pydict({"text": [r["text"]]}) for r in docs]
    words = np.array([], dtype=np.uint64)
    chunks = [(h, sizes) for _, h, sizes in suffix_tree._chunks(iter(batches), 0, 1000)]
    assert len(chunks) >= 10
    parts = [suffix_tree._places(*x) for x in chunks]
    whole = suffix_tree._next_words(parts, words)
    want = Counter((a, b) for h, n in chunks for t in np.split(h, np.cumsum(n)[:-1]) for a, b in zip(t[:-1].tolist(), t[1:].tolist()))
    assert {(a, b): n for a, b, n in zip(*(x.tolist() for x in whole))} == want
    assert 2 * len(whole[0]) < sum(len(suffix_tree._next_words([x], words)[0]) for x in parts)


def _packed(spark, sources, window):
    """Per window, tokens by source; all windows are checked to be full and without gaps."""
    rows = [(k, f"word{k} " * (3 + k % 5), s) for k, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source, mix, starts = {r[0]: r[2] for r in rows}, defaultdict(Counter), defaultdict(list)
    done = defaultdict(list)
    for p in pack(docs, tokenizer("word_bpe_49k.json"), window=window).collect():
        mix[p["sequence_id"]][source[p["doc_id"]]] += p["length"]
        starts[p["sequence_id"]].append((p["offset"], p["length"]))
        done[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
    assert sorted(mix) == list(range(len(mix))) and len(done) == len(rows)
    for k, own in starts.items():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1])
        assert sum(n for _, n in own) == window or k == len(mix) - 1
    for own in done.values():
        own.sort()
        assert [s for s, _, _ in own] == list(np.cumsum([0, *[n for _, n, _ in own]])[:-1])
        assert sum(n for _, n, _ in own) == own[0][2]
    return mix


def test_packing_keeps_proportions_of_many_sources(spark):
    sources = ["hot" if k % 3 == 0 else f"s{k % 100}" for k in range(3000)]
    mix = _packed(spark, sources, 512)
    total = Counter()
    for own in mix.values():
        total.update(own)
    every = sum(total.values())
    assert len(total) > 65
    for k, own in mix.items():
        if k < len(mix) - 1:
            assert all(abs(own[s] - 512 * n / every) <= 2 for s, n in total.items()), k


def test_packing_spreads_sources_below_a_token_a_window(spark):
    """Also where all sources are so small, and where only a few documents are."""
    for sources in ([f"s{k // 50}" for k in range(2000)], ["hot"] * 1500 + [f"s{k // 10}" for k in range(40)]):
        mix = _packed(spark, sources, 16)
        total, half = Counter(), Counter()
        for k, own in mix.items():
            total.update(own)
            if k < len(mix) / 2:
                half.update(own)
        for s, n in total.items():
            assert abs(half[s] - n / 2) <= 40, s


@pytest.mark.parametrize("size", [20, 1_000, 10_000])
def test_imatch_likeness_means_the_same_at_every_length(size):
    random, none = np.random.default_rng(size), np.zeros(0, dtype=np.uint64)
    for kept, want in ((0.6, 0.6 / 1.4), (0.95, 0.95 / 1.05), (0, 0)):
        got = []
        for _ in range(20):
            a, new = (random.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(2))
            b = np.r_[a[: int(kept * size)], new[int(kept * size) :]]
            got.append(imatch.likeness(*(imatch.fingerprint(np.unique(t), none) for t in (a, b))))
        assert np.mean(got) == pytest.approx(want, abs=0.1)


def test_suffix_tree_filter_is_exchanged_by_task(spark):
    """Bits are put together in each task: no row for every key leaves it. The words are those of all keys, set one by one."""
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 3000):
        keys = rng.integers(-(2**63), 2**63 - 1, n)
        df = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3)
        got = suffix_tree._filter(df, n)
        want = np.zeros(1 << max(4, n.bit_length()), dtype=np.uint64)
        for at, bits in zip(*suffix_tree._slots(keys, len(want)), strict=True):
            want[at] |= bits
        assert (got == want).all() and suffix_tree._passes(keys, got).all()
    text = spark.range(3000).selectExpr("xxhash64(id) AS key")
    sent = []
    plain = type(text).mapInArrow
    try:
        type(text).mapInArrow = lambda self, f, schema, *a, **k: sent.append(plain(self, f, schema, *a, **k)) or sent[-1]
        suffix_tree._filter(text, 3000)
    finally:
        type(text).mapInArrow = plain
    assert sent[0].count() <= 16 * text.rdd.getNumPartitions()


def test_language_training_takes_few_words_at_a_time(spark, monkeypatch):
    """The n-grams of all words of a batch at once took some hundred bytes for each word several times; the table is the same."""
    rng = np.random.default_rng(2)
    rows = [(" ".join("".join(rng.choice(list(letters), 9)) for _ in range(400)), lang) for lang, letters in (("x", "abcdefgh"), ("y", "ghijklmn")) for _ in range(30)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    asked = []
    whole = language_id.grams
    monkeypatch.setattr(language_id, "grams", lambda words: asked.append(len(words)) or whole(words))
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: spark.createDataFrame(
        [r for b in f(iter(self.toArrow().combine_chunks().to_batches())) for r in map(tuple, b.to_pandas().itertuples(index=False))], schema))
    monkeypatch.setattr(language_id, "GRAM_WORDS", 1000, raising=False)
    model = language_id.train(docs)
    assert max(asked) <= 1000 and sum(asked) > 20_000
    monkeypatch.setattr(language_id, "GRAM_WORDS", 10**9, raising=False)
    assert np.allclose(language_id.train(docs).table, model.table, rtol=1e-6)
