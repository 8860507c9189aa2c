"""Operator 3, n-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_words, mixed, running_totals, written
from .components import connected_components
from .packed import bucket_count, exchange

#: Documents of a block of the product.
BLOCK = 1024
#: How often frequent tokens are looked for, and how many of them are kept each time.
ORDER_ROUNDS, ORDER_TOKENS = 2, 500_000
#: Cells of the product up to which a token is added up cell by cell.
SPARSE_CELLS = 4096
#: Tokens that small groups of candidates share a task by.
TASK_TOKENS = 2_000_000


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams, A-Z lower-cased; of the whole sequence if shorter."""
    h = hash_words(text.lower().split())
    if not len(h):
        return h
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out = mixed(out + h[k : len(h) - size + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed(out))


def _shared_counts(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, shared): how many shingles a document has, and how many of them another one has too."""

    def rows(doc: np.ndarray, shared: np.ndarray, n: np.ndarray) -> list[pa.RecordBatch]:
        if not len(doc):
            return []
        return [pa.RecordBatch.from_arrays([pa.array(doc), pa.array(shared), pa.array(n)], ["doc_id", "shared", "n"])]

    def counts(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(doc, return_counts=True)

    def shared_by(new: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Masks: first entry of its document for a shingle (repeated rows have more); shingle of several documents."""
        own = new | np.r_[True, doc[1:] != doc[:-1]]
        run = np.cumsum(new) - 1
        return own, (np.bincount(run, own) > 1)[run]

    def local(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple:
        own, several = shared_by(new, doc)
        ids, n_all = counts(doc[own])
        hit = np.zeros(len(ids), np.int64)
        some, found = counts(doc[own & several])
        hit[np.searchsorted(ids, some)] = found
        # the place has served; from here on it says whether the entry is counted already
        place[:] = several
        return new, rows(ids, hit, n_all)

    def judge(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> list[pa.RecordBatch]:
        own, several = shared_by(new, doc)
        ids, found = counts(doc[own & several & (place == 0)])
        return rows(ids, found, np.zeros(len(ids), np.int64))

    def combine(found: pa.Table) -> pa.Table:
        ids, at = np.unique(found.column(0).to_numpy(), return_inverse=True)
        shared = np.bincount(at, found.column(1).to_numpy(), len(ids)).astype(np.int64)
        size = np.zeros(len(ids), np.int64)
        np.maximum.at(size, at, found.column(2).to_numpy())
        return pa.table({"doc_id": ids, "n_shingles": size, "shared": shared})

    return exchange(
        docs, bucket_count(docs), lambda t: shingles(t, n), local, judge, "doc_id long, shared long, n long", combine,
        "doc_id long, n_shingles long, shared long",
    )


def _slots(ids: np.ndarray, size: int) -> np.ndarray:
    """Three slots of a filter of `size` bits for each id."""
    first = mixed(ids.view(np.uint64) + np.uint64(1))
    second = mixed(first ^ np.uint64(0xC2B2AE3D27D4EB4F))
    return np.stack([first, second, mixed(second)]) % np.uint64(size)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of a table of ids, as 64-bit words. Spark sets the bits; 16 MB come to the driver at most, and
    beyond some ten million ids the filter lets more and more others pass, which costs time only."""
    size = 1 << min(27, max(10, (32 * ids.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _slots(batch.column(0).to_numpy(), size).ravel()
            bits = (np.uint64(1) << (slots & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["word", "bits"])

    rows = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(size // 64, dtype=np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def _passes(ids: np.ndarray, words: np.ndarray) -> np.ndarray:
    slots = _slots(ids, len(words) * 64)
    return ((words[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)).all(axis=0)


def _sets(docs: DataFrame, n: int, words: np.ndarray) -> DataFrame:
    """(doc_id, n, key, tokens) of the documents whose ids pass the filter: set size, 128-bit hash of the set, sorted
    shingles as bytes."""
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_passes(batch.column(0).to_numpy(), shared.value)))
            sets = [shingles(t or b"", n).tobytes() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(s) // 8 for s in sets], pa.int64()),
                    pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary()),
                ],
                ["doc_id", "n", "key", "tokens"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, key binary, tokens binary").where("n > 0")


def _prefixes(sets: DataFrame, percent: int, known: np.ndarray, level: np.ndarray) -> DataFrame:
    """(token, node): the first n - ceil(percent% n) + 1 tokens of each set, in one order for all: by level (0 where
    it isn't known), then by hash. Two sets that link share one of them, whatever the levels are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parts = [], []
            for node, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(tokens, dtype=np.uint64)
                keep = len(s) - -(-percent * len(s) // 100) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[at] == s, level[at], 0), kind="stable")]
                parts.append(s[:keep])
                nodes += [node] * len(s[:keep])
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(parts).view(np.int64)), pa.array(nodes, pa.int64())], ["token", "node"]
                )

    return sets.select("node", "tokens").mapInArrow(run, "token long, node long")


def _frequency_levels(nodes: DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that are frequent in prefixes, and the logarithm of how often. Ordering prefixes by these levels
    keeps shared passages from tying unlike documents into one group. Looked for ORDER_ROUNDS times, each time in the
    prefixes that the levels so far give; at most ORDER_TOKENS of a round come to the driver."""
    known, level = np.zeros(0, np.uint64), np.zeros(0, np.int8)
    for _ in range(ORDER_ROUNDS):
        counts = _prefixes(nodes, percent, known, level).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
        counts = written(counts.where("c >= 4"), "ngram-levels")
        total = counts.agg(F.sum("c")).first()[0] or 0
        found = counts.where(F.col("c") >= max(4, total // ORDER_TOKENS)).toPandas()
        discard(counts)
        tokens = np.r_[known, found["token"].to_numpy(np.int64).view(np.uint64)]
        levels = np.r_[level, np.log2(found["c"].to_numpy(np.float64)).astype(np.int8)]
        order = np.lexsort((-levels, tokens))
        tokens, levels = tokens[order], levels[order]
        first = np.r_[True, tokens[1:] != tokens[:-1]] if len(tokens) else np.zeros(0, bool)
        known, level = tokens[first], levels[first]
    return known, level


def _columns(sets: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The incidence matrix of some rows by columns: distinct tokens; rows in order of their tokens; where each
    token's rows begin, and how many they are."""
    tokens = np.concatenate([sets[r] for r in rows])
    own = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    order = np.argsort(tokens, kind="stable")
    distinct, first, count = np.unique(tokens[order], return_index=True, return_counts=True)
    return distinct, own[order], first, count


def _dense(own: np.ndarray, first: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    column = np.repeat(np.arange(len(first)), count)
    k = np.arange(len(column)) - np.repeat(np.cumsum(count) - count, count)
    m = np.zeros((n, len(first)), dtype=np.float32)
    m[own[first[column] + k], column] = 1
    return m


def block_product(
    ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the rows `left` and the rows `right` of a block pair (the same rows for a block with itself).

    Overlap counts are accumulated as the product of the two incidence matrices over the tokens that both hold, cell by
    cell for rare tokens and as dense blocks for frequent ones; pairs stay that reach percent% of the union their sizes leave. Returns for each
    row of left, then right: the smallest linked id (through any number of links), and the linked weight.
    """
    n_left, n_right = len(left), len(right)
    same = n_left == n_right and bool((left == right).all())
    token_l, own_l, first_l, count_l = _columns(sets, left)
    token_r, own_r, first_r, count_r = _columns(sets, right)
    _, at_l, at_r = np.intersect1d(token_l, token_r, assume_unique=True, return_indices=True)
    if same:
        at_l = at_r = at_l[count_l[at_l] > 1]  # alone, a document only meets itself
    first_l, count_l, first_r, count_r = first_l[at_l], count_l[at_l], first_r[at_r], count_r[at_r]
    cells = count_l * count_r
    overlap = np.zeros(n_left * n_right, dtype=np.float32)
    # tokens of few documents: add up their cells
    few = np.flatnonzero(cells <= SPARSE_CELLS)
    steps = np.searchsorted(np.cumsum(cells[few]), np.arange(0, int(cells[few].sum()) + 1, 2_000_000)[1:]) + 1
    for some in np.split(few, np.unique(steps[steps < len(few)])):
        t = np.repeat(some, cells[some])
        k = np.arange(len(t)) - np.repeat(np.cumsum(cells[some]) - cells[some], cells[some])
        i, j = own_l[first_l[t] + k // count_r[t]], own_r[first_r[t] + k % count_r[t]]
        overlap += np.bincount(i * n_right + j, minlength=len(overlap)).astype(np.float32)
    overlap = overlap.reshape(n_left, n_right)
    # tokens of many: a dense product of some thousand columns at a time
    many = np.flatnonzero(cells > SPARSE_CELLS)
    for start in range(0, len(many), 4096):
        some = many[start : start + 4096]
        overlap += _dense(own_l, first_l[some], count_l[some], n_left) @ _dense(own_r, first_r[some], count_r[some], n_right).T
    union = sizes[left][:, None] + sizes[right][None, :] - overlap
    linked = (100 * overlap.astype(np.int64) >= percent * union.astype(np.int64)) & (overlap > 0)
    linked &= ids[left][:, None] != ids[right][None, :]
    weight_left, weight_right = linked @ weights[right], linked.T @ weights[left]
    la, lb = ids[left].copy(), ids[right].copy()
    top = np.iinfo(np.int64).max
    while len(la) and len(lb):
        na = np.minimum(la, np.where(linked, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(linked, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return np.r_[la, lb], np.r_[weight_left, weight_right], linked


def ngram_join(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    A document's set: its distinct word n-grams (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased), or the whole sequence
    if it has fewer words. Two documents link when 100 * intersection >= percent * union. component_id is the smallest
    doc_id reachable by links; n_links counts the documents that a document links with. The work is exact at any group
    size. Shingles are compared as 64-bit hashes; only the sets of two candidates meet, never all shingles of the
    corpus, so that sets of 1,000 shingles differ from the words with a chance of some 10**-13 a pair:

    1. Count, over all shingles of all documents, how many of a document's shingles any other document has. Below
       percent% of its size it can't link: few documents stay.
    2. Collapse equal sets to one node (smallest doc_id).
    3. Nodes that share a token of their prefixes (frequent tokens ordered last) form groups of candidates. A token only
       ties its holders to the smallest of them; it makes no pairs.
    4. Inside each group, sorted by size and cut into blocks of 1,024 nodes, multiply the incidence matrices of the
       block pairs whose sizes can reach the bound. A task emits a spanning tree and link counts, not pairs.
    5. Components of these links, then back to the documents.

    Null and empty texts, and rows whose id is null, have an empty set, no link, and are their own component. Rows
    with equal ids should have equal texts; they give one result each. Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    usable = base.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    counts = written(_shared_counts(usable, n), "ngram-counts")
    near = counts.where(F.col("shared") * 100 >= F.col("n_shingles") * percent).select("doc_id")
    # a few others may pass the filter: more candidates, the same links
    sets = written(_sets(usable, n, _id_filter(near)), "ngram-sets")
    by_set = sets.groupBy("key", "n").agg(F.min("doc_id").alias("node"), F.countDistinct("doc_id").alias("weight"))
    by_set = written(by_set, "ngram-nodes")
    members = sets.select("doc_id", "key", "n").distinct().join(by_set, ["key", "n"]).select("doc_id", "node", "weight")
    members = written(members, "ngram-members")
    # one row for each node, whatever repeats there are
    nodes = sets.join(by_set.select("node", "weight").hint("shuffle_merge"), F.col("doc_id") == F.col("node")).groupBy("node").agg(
        F.first("weight").alias("weight"), F.first("n").alias("n"), F.first("tokens").alias("tokens")
    )
    nodes = written(nodes, "ngram-nodes")
    discard(sets)

    prefixes = _prefixes(nodes, percent, *_frequency_levels(nodes, percent))
    stars = prefixes.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    ties = prefixes.join(stars, "token").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = connected_components(ties)

    grouped = nodes.drop("tokens").join(groups, "node").withColumn("one", F.lit(1))
    ranked = running_totals(grouped, ["component"], ["n", "node"], "one", "ngram-groups").select(
        "node", "weight", "n", "component", (F.col("before") / BLOCK).cast("int").alias("block"),
        F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"),
    )
    ranked = written(ranked, "ngram-blocks")
    bounds = ranked.groupBy("component", "block", "blocks").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = bounds.alias("a"), bounds.alias("b")
    pairs = a.join(b, F.col("a.component") == F.col("b.component")).where(
        "a.block <= b.block and 100 * a.high >= b.low * " + str(percent)
    )
    pairs = pairs.select("a.component", F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    sides = pairs.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    small_tasks = max(1, int((ranked.where("blocks = 1").agg(F.sum("n")).first()[0] or 0) / TASK_TOKENS) * 2)
    tasks = ranked.join(sides, ["component", "block"]).hint("shuffle_merge").join(nodes.select("node", "tokens"), "node").select(
        "component", "block", "node", "weight", "n", "tokens", "i", "j",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(small_tasks)).cast("string"))
        .otherwise(F.concat_ws("-", "component", "i", "j")).alias("task"),
    )

    def multiply(table: pa.Table) -> pa.Table:
        group = table.column("component").to_numpy()
        block = table.column("block").to_numpy()
        i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
        ids, weights, sizes = (table.column(c).to_numpy() for c in ("node", "weight", "n"))
        sets = [np.frombuffer(t.as_py(), dtype=np.uint64) for t in table.column("tokens")]
        node, least, weight = [], [], []
        order = np.argsort(group, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if not len(rows):
                continue
            left = rows[block[rows] == i[rows[0]]]
            same = i[rows[0]] == j[rows[0]]
            right = left if same else rows[block[rows] == j[rows[0]]]
            low, found, _ = block_product(ids, sizes, weights, sets, left, right, percent)
            keep = slice(0, len(left)) if same else slice(0, None)
            node.append(np.r_[ids[left], ids[right]][keep])
            least.append(low[keep])
            weight.append(found[keep])
        return pa.table(
            {
                "node": pa.array(np.concatenate(node) if node else [], pa.int64()),
                "least": pa.array(np.concatenate(least) if least else [], pa.int64()),
                "weight": pa.array(np.concatenate(weight) if weight else [], pa.int64()),
            }
        )

    found = written(tasks.groupBy("task").applyInArrow(multiply, "node long, least long, weight long"), "ngram-links")
    discard(nodes)
    links = found.groupBy("node").agg(F.sum("weight").alias("linked"))
    component = connected_components(found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    classes = members.join(component, "node", "left").join(links, "node", "left")
    classes = classes.groupBy("doc_id").agg(
        F.min(F.coalesce("component", "node")).alias("component_id"),
        F.max(F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    return (
        base.select("doc_id")
        .join(counts, "doc_id", "left")
        .join(classes, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"),
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )
