"""Operator 8, language-model scoring: a probabilistic suffix tree over words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hash_words, mixed, row_key, written
from .packed import arrow_schema, bucket_count, bucket_width, pack_buckets, to_groups, unpack_bodies, unpack_table, wrap

#: Stands for a text's end among the word hashes.
END = np.uint64(0x8000000000000001)
#: Bytes that belong to words; masks of a little-endian number's first 0 to 8 bytes.
_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FIRST_BYTES = np.array([256**k - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Tells the key of a context from that of the same words as a shorter context and its next word.
CONTEXT = 0x2545F4914F6CDD1D
#: Tokens that a task works on at once; in scoring some 600 bytes each, as a token has several keys there.
CHUNK_TOKENS = 1_000_000
SCORE_TOKENS = 250_000
#: Tokens (some 40 bytes each) or longer grams that are counted together before they are sent, and entries that scoring
#: sends together: equal ones and neighbours share more bytes, the more there are.
COUNT_TOKENS, COUNT_GRAMS, SCORE_ENTRIES = 3_000_000, 1_500_000, 1_000_000
#: Words, and contexts and next words of each length, that the head holds at most.
HEAD_ENTRIES = 1 << 19
#: Tokens a range of keys should have in scoring: few ranges, so that each sums up several keys of a document.
SCORE_BUCKET = 2_500_000
#: Parts, by range of its words, in which a filter's bits are exchanged.
FILTER_PARTS = 16
#: A word that makes up more than this share of all tokens is counted as a context in so many parts.
HOT_SHARE, HOT_PARTS = 1 / 200, 8


@dataclass
class Level:
    """The head of one context length, its most common part: sorted context keys; kept mass by (state, word); what is
    left to the suffix; log10 of what a kept word gains over its share of what is left."""

    keys: np.ndarray
    pairs: np.ndarray
    mass: np.ndarray
    rest: np.ndarray
    gain: np.ndarray


@dataclass
class SuffixTree:
    """words/counts: the common words (sorted hashes), and levels: the common contexts and next words, all of which
    number at most HEAD_ENTRIES (1 / common_share, where that is given) each. They only spare a join: grams, tables in Spark of any size, have all other
    retained contexts and next words (key, value), and passing is a bounded Bloom filter of their keys. gains: by context
    length, nats that its contexts gain for each training token."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    discount: float
    levels: list[Level] = field(default_factory=list)
    depth: int = 0
    gains: list[float] = field(default_factory=list)
    passing: np.ndarray | None = None
    grams: DataFrame | None = None

    def root(self, count: np.ndarray) -> np.ndarray:
        """Probability of a token by its training count; all unknown tokens are one symbol with the discounted mass."""
        known = np.maximum(count - self.discount, 1e-300) / max(1, self.tokens)
        return np.where(count > 0, known, self.unknown)

    @property
    def unknown(self) -> float:
        return self.discount * self.distinct / self.tokens if self.tokens else 1.0


def _tokens(texts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each, and the number of tokens of each text."""
    lower = [t.lower() for t in texts]
    joined = b"\n".join([*lower, bytes(8)])
    raw = np.frombuffer(joined, np.uint8)
    inside = _IN_WORD[raw[:-8]]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    edges = np.r_[0, edges] if len(inside) and inside[0] else edges
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    own = _word_hashes(joined, starts, lengths)
    own[own == END] ^= np.uint64(2)
    after = np.cumsum([len(t) + 1 for t in lower], dtype=np.int64)
    sizes = np.diff(np.r_[0, np.searchsorted(starts, after)]) + 1
    h = np.full(len(own) + len(lower), END)
    words = np.ones(len(h), dtype=bool)
    words[np.cumsum(sizes) - 1] = False
    h[words] = own
    return h, sizes


def _word_hashes(joined: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words by eight bytes a step; long ones by SipHash. Eight bytes must follow the last word."""
    eight = np.ndarray((max(0, len(joined) - 7),), "<u8", joined, strides=(1,))
    h = mixed(mixed(eight[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _ODD)
    more = np.flatnonzero((lengths > 8) & (lengths <= 64))
    for done in range(8, 64, 8):
        more = more[lengths[more] > done]
        h[more] = _combined(h[more], eight[starts[more] + done] & _FIRST_BYTES[np.minimum(lengths[more] - done, 8)])
    far = np.flatnonzero(lengths > 64)
    h[far] = hash_words([joined[a:b] for a, b in zip(starts[far].tolist(), (starts + lengths)[far].tolist(), strict=True)])
    return h


def _chunks(
    batches: Iterator[pa.RecordBatch], text_at: int, tokens: int = CHUNK_TOKENS
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, hashes, sizes) for about so many tokens of one or more batches, or for one text."""
    firsts, texts, held = [], [], 0
    for batch in batches:
        start = 0
        for k, t in enumerate(batch.column(text_at).cast(pa.large_binary())):
            texts.append(t.as_py() or b"")
            held += len(texts[-1]) // 6 + 1
            if held >= tokens:
                firsts.append(batch.column(0).slice(start, k + 1 - start))
                yield pa.concat_arrays(firsts), *_tokens(texts)
                firsts, texts, held, start = [], [], 0, k + 1
        firsts.append(batch.column(0).slice(start) if text_at else batch.column(0).slice(0, 0))
    if texts:
        yield pa.concat_arrays(firsts), *_tokens(texts)


def _index(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Place of each hash among the common words, or -1."""
    if not len(words):
        return np.full(len(h), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return np.where(words[at] == h, at, -1)


def _combined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Key of n + 1 words from those of its first n and of its last n."""
    return mixed(mixed(x) + (y ^ np.uint64(0xD6E8FEB86659FD93)))


def _grams(h: np.ndarray, sizes: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By context length: where there is a context; there, the key of the context, of its words and the next one, and
    of the latter without the first word."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own = h
    for length in range(1, depth + 1):
        longer = np.zeros_like(h)
        longer[1:] = _combined(own[:-1], own[1:])
        at = np.flatnonzero(place >= length)
        yield at, own[at - 1], longer[at], own[at]
        own = longer


def _find(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _slots(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A filter's word for each key, and three bits in it."""
    m = mixed(mixed(keys.view(np.uint64) + np.uint64(1)))
    one, low = np.uint64(1), np.uint64(63)
    bits = (one << (m & low)) | (one << ((m >> np.uint64(6)) & low)) | (one << ((m >> np.uint64(12)) & low))
    return ((m >> np.uint64(18)) % np.uint64(size)).astype(np.int64), bits


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """Bloom filter of a table of about n keys, as 64-bit words. Each task sets the bits of its keys and sends what it has set as
    FILTER_PARTS rows at most; 16 MB come to the driver at most, and beyond some ten million keys the filter lets more and more others
    pass, which costs time only."""
    size = 1 << min(21, max(4, n.bit_length()))
    width = size // FILTER_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size, dtype=np.uint64)
        for batch in batches:
            np.bitwise_or.at(words, *_slots(batch.column(0).to_numpy(), size))
        at = np.flatnonzero(words)
        parts = np.split(at, np.searchsorted(at, np.arange(width, size, width)))
        bodies = [(some % width).astype("<u4").tobytes() + words[some].tobytes() for some in parts]
        sent = [k for k, some in enumerate(parts) if len(some)]
        yield pa.RecordBatch.from_arrays([pa.array(sent, pa.int32()), pa.array([bodies[k] for k in sent], pa.binary())], ["part", "body"])

    def together(table: pa.Table) -> pa.Table:
        words = np.zeros(width, dtype=np.uint64)
        for body in table.column("body"):
            n = len(body.as_py()) // 12
            words[np.frombuffer(body.as_py(), "<u4", n)] |= np.frombuffer(body.as_py(), "<u8", n, 4 * n)
        return pa.table([table.column("part").slice(0, 1), pa.array([words.tobytes()], pa.binary())], ["part", "words"])

    rows = keys.mapInArrow(run, "part int, body binary").groupBy("part").applyInArrow(together, "part int, words binary").toArrow()
    words = np.zeros((FILTER_PARTS, width), dtype=np.uint64)
    for part, body in zip(rows["part"].to_pylist(), rows["words"].to_pylist(), strict=True):
        words[part] = np.frombuffer(body, np.uint64)
    return words.ravel()


def _passes(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    at, bits = _slots(keys, len(words))
    return words[at] & bits == bits


def _conditional(tree: SuffixTree, index: np.ndarray, states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) with P(token | context) = a + b * P_root(token), by interpolation along the suffixes."""
    a, b = np.zeros(len(index)), np.ones(len(index))
    for level, state in zip(tree.levels, states, strict=True):
        some = state >= 0
        pair = np.where(some & (index >= 0), state * max(1, len(tree.words)) + index, -1)
        at = _find(pair, level.pairs)
        own = np.where(at >= 0, level.mass[np.maximum(at, 0)], 0.0) if len(level.mass) else np.zeros(len(index))
        rest = np.where(some, level.rest[np.maximum(state, 0)], 1.0) if len(level.rest) else np.ones(len(index))
        a, b = own + rest * a, rest * b
    return a, b


def _counted(
    texts: DataFrame, tree: SuffixTree, length: int, candidates: np.ndarray | None, n_buckets: int, least_context: int, least_next: int
) -> DataFrame:
    """(ctx, below, n, size, gram, c): how often each next word follows each context of `length` words, from least_next
    times and for contexts from least_context times on; the count of a common word.

    Pairs go packed to ranges of contexts, where each context's differ little from one another; those of
    the most frequent words are dealt out further by the next word.
    """
    width, most = bucket_width(n_buckets), tree.words[tree.counts > HOT_SHARE * tree.tokens]
    shared = texts.sparkSession.sparkContext.broadcast((tree.words, tree.counts, most, candidates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _, most, candidates = shared.value
        packer = zstandard.ZstdCompressor(level=1)
        limit = COUNT_TOKENS if length == 1 else COUNT_GRAMS

        def send(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            ctx, below, n = _next_words(held, words) if length == 1 else _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
            bucket = (ctx // width).astype(np.int64)
            often = _index(ctx, most) >= 0 if length == 1 else np.zeros(len(ctx), dtype=bool)
            bucket[often] += n_buckets * (1 + (below[often] % np.uint64(HOT_PARTS)).astype(np.int64))
            hot = np.flatnonzero(often)
            for rows in (np.flatnonzero(~often), hot[np.argsort(bucket[hot], kind="stable")]):
                for some, bodies in pack_buckets(bucket[rows], [ctx[rows], below[rows], n[rows]], packer):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "body"])

        held: list[tuple[np.ndarray, ...]] = []
        for _, h, sizes in _chunks(batches, 0):
            held.append(_places(h, sizes) if length == 1 else _candidate_grams(h, sizes, length, candidates))
            if sum(len(x[1]) for x in held) >= limit:
                yield from send(held)
                held = []
        if held:
            yield from send(held)

    def tally(table: pa.Table) -> pa.Table:
        words, counts, _, _ = shared.value
        ctx, below, n = unpack_bodies(table.column("body"), ["u8", "u8", "u4"])
        order = np.lexsort((below, ctx))
        ctx, below, n = ctx[order], below[order], n[order].astype(np.int64)
        first = np.flatnonzero(_first(ctx, below))
        n = np.add.reduceat(n, first) if len(first) else n
        ctx, below = ctx[first], below[first]
        runs = np.flatnonzero(_first(ctx))
        size = np.repeat(np.add.reduceat(n, runs), np.diff(np.r_[runs, len(ctx)])) if len(runs) else n
        if length == 1:
            known = _index(ctx, words)
            size = np.where(known >= 0, counts[np.maximum(known, 0)], size) if len(counts) else size
        some = (n >= least_next) & (size >= least_context)
        ctx, below, n, size = ctx[some], below[some], n[some], size[some]
        c = pa.nulls(len(n), pa.int64())
        if length == 1 and len(words):
            known = below < len(words)
            at = np.where(known, below, 0).astype(np.int64)
            below, c = np.where(known, words[at], below), pa.array(counts[at], mask=~known)
        names = ["ctx", "below", "n", "size", "gram", "c"]
        keys = [pa.array(x.view(np.int64)) for x in (ctx, below)]
        return pa.table([*keys, pa.array(n), pa.array(size), pa.array(_combined(ctx, below).view(np.int64)), c], names)

    packed = texts.mapInArrow(count, "bucket long, body binary")
    return packed.groupBy("bucket").applyInArrow(tally, "ctx long, below long, n long, size long, gram long, c long")


def _candidate_grams(h: np.ndarray, sizes: np.ndarray, length: int, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of `length` words, and what follows them without their first word, that pass the filter of candidates."""
    shorter = np.zeros_like(h)
    for place, ctx, _, below in _grams(h, sizes, length):
        last = shorter[place] ^ np.uint64(CONTEXT)
        shorter[place] = ctx  # the context of this length before a token
    some = np.flatnonzero(_passes(ctx.view(np.int64), candidates))
    some = some[_passes(last[some].view(np.int64), candidates)]
    return ctx[some], below[some]


def _places(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, each token's place among them, and the texts' sizes."""
    word, at = np.unique(h, return_inverse=True)
    return word, at.astype(np.uint32), sizes


def _next_words(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, next word, count), sorted, of single words; next words that are common are told by their place."""
    word = np.unique(np.concatenate([own for own, _, _ in parts]))
    known = _index(word, words)
    code = np.where(known >= 0, known.astype(np.uint64), word)
    by_code = np.argsort(code)
    rank = np.empty(len(word), dtype=np.uint64)
    rank[by_code] = np.arange(len(word), dtype=np.uint64)
    pair = np.empty(sum(len(at) - len(sizes) for _, at, sizes in parts), dtype=np.uint64)
    done, n_words = 0, np.uint64(len(word))
    for own, at, sizes in parts:
        place = np.searchsorted(word, own)
        follows = np.ones(len(at), dtype=bool)
        follows[np.cumsum(sizes) - sizes] = False
        follows = np.flatnonzero(follows)
        some = pair[done : done + len(follows)]
        some[:] = place[at[follows - 1]]
        some *= n_words
        some += rank[place][at[follows]]
        done += len(follows)
    pair.sort()
    first = np.flatnonzero(_first(pair))
    n = np.diff(np.r_[first, len(pair)]).astype(np.uint32)
    ctx, below = np.divmod(pair[first], n_words)
    return word[ctx.view(np.int64)], code[by_code][below.view(np.int64)], n


def _distinct(ctx: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ctx, below, count), sorted."""
    order = np.lexsort((below, ctx))
    ctx, below = ctx[order], below[order]
    first = np.flatnonzero(_first(ctx, below))
    return ctx[first], below[first], np.diff(np.r_[first, len(ctx)]).astype(np.uint32)


def _columns(df: DataFrame) -> list[np.ndarray]:
    """A bounded table's columns, none of which has nulls."""
    found = [c.to_numpy() for c in df.toArrow().columns]
    pa.default_memory_pool().release_unused()
    return found


def _head_from(counts: DataFrame, most: int) -> float:
    """The least number, 2 or more and in steps of a sixth of a doubling, that at most so many counts (column c) reach."""
    by_step = counts.where("c >= 2").groupBy(F.floor(6 * F.log2("c")).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, 2.0
    for step, n in sorted(map(tuple, by_step), reverse=True):
        held += n
        if held > most:
            return 2.0 ** ((step + 1) / 6)
    return least


def _first(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    n = len(keys[0])
    return np.r_[n > 0, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])][:n]


def train(
    docs: DataFrame,
    max_depth: int | None = None,
    common_share: float | None = None,
    least_context: int = 24,
    least_next: int = 6,
    divergence: float = 0.02,
    min_depth: int = 3,
    least_gain: float = 0.1,
    text_col: str = "text",
) -> tuple[SuffixTree, DataFrame]:
    """The tree, and the table (word, c) of all distinct tokens' counts, which stays in Spark.

    A context of any number of words is a candidate when it occurs least_context times and its suffix, one word less, is
    not always followed by the same word; a next word gets its own probability there when it is seen least_next times. A
    context is retained when the divergence of its next-word distribution from that of its longest retained suffix (own
    words one by one, all others together) is `divergence` nats or more and not within chance. Its words' counts are
    discounted by a half; the mass left goes to the suffix. Contexts of min_depth words are always looked for;
    longer ones as long as those of the last length gain least_gain nats for each training token (count times divergence,
    over all of them; among many near copies chance retains some at any length), or up to max_depth words. No bound on a
    context depends on the number of tokens, so the tree grows with the corpus. The head takes the most frequent words,
    contexts and next words, HEAD_ENTRIES of each length, or those of common_share of all tokens; scores are the same.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    spark = docs.sparkSession

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, _sizes in _chunks(batches, 0):
            w, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["word", "c"])

    vocabulary = texts.mapInArrow(count_words, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    vocabulary = written(vocabulary, "lm-words")
    n, v, n1, n2 = vocabulary.agg(
        F.sum("c"), F.count(F.lit(1)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    ).first()
    n = n or 0
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    often = _head_from(vocabulary.select("c"), HEAD_ENTRIES) if common_share is None else max(2, common_share * n)
    hashes, counts = _columns(vocabulary.where(F.col("c") >= often))
    order = np.argsort(hashes.view(np.uint64))
    tree = SuffixTree(hashes.view(np.uint64)[order], counts[order], n, v, discount)
    width = max(1, len(tree.words))
    root = (F.col("c") - F.lit(discount)) / F.lit(float(max(1, n)))
    n_buckets = bucket_count(texts)
    candidates, lower, grams, n_grams = None, None, [], 0
    while max_depth is None or tree.depth < max_depth:
        length = tree.depth + 1
        pairs = _counted(texts, tree, length, candidates, n_buckets, least_context, least_next)
        if lower is None:
            # common words bring their counts along; each of the others is a small share of all rows
            pairs = written(pairs, "lm-pairs")
            rare = pairs.where("c is null").drop("c").join(vocabulary.withColumnRenamed("word", "below"), "below")
            rows = pairs.where("c is not null").unionByName(rare).withColumn("q", root).withColumn("word", F.col("below"))
        else:
            rows = pairs.join(lower, "below")
        in_context = Window.partitionBy("ctx")
        own, seen = F.count(F.lit(1)).over(in_context), F.sum("n").over(in_context)
        p, q = F.col("n") / F.col("size"), F.sum("q").over(in_context)
        left = F.greatest(1 - seen / F.col("size"), F.lit(0.0))
        others = F.when(left > 1e-12, left * F.log(F.greatest(left, F.lit(1e-300)) / (1 - F.least(q, F.lit(1 - 1e-12))))).otherwise(0.0)
        rows = rows.select("ctx", "gram", "word", "n", "size", "q").withColumns(
            {
                "own": own,
                "d": F.sum(p * F.log(p / F.col("q"))).over(in_context) + others,
                "open": (own > 1) | (seen < F.col("size")),
                "rest": 1 - (seen - 0.5 * own) / F.col("size"),
                "one": F.min("gram").over(in_context) == F.col("gram"),
            }
        )
        own = F.col("own")
        retained = (F.col("d") >= divergence) & (2 * F.col("size") * F.col("d") >= own + 4 * F.sqrt(2 * own + 1))
        mass = (F.col("n") - 0.5) / F.col("size")
        gain = F.log10(1 + mass / (F.col("rest") * F.col("q")))
        found = rows.withColumn("retained", retained).select(
            "ctx", "gram", "n", "size", F.when(F.col("one"), F.col("d")).alias("d"), "open", "one", "retained",
            F.when(F.col("one"), F.col("rest")).alias("rest"),
            F.when(F.col("n") >= F.lit(often), F.col("word")).alias("word"),
            F.when(F.col("retained"), mass + F.col("rest") * F.col("q")).otherwise(F.col("q")).alias("p"),
            F.when(F.col("retained"), gain).alias("gain"),
        )
        found = written(found, "lm-grams")
        if lower is None:
            discard(pairs)
        kept = found.where("retained and one")
        longer, is_open = F.col("n") >= least_context, F.col("one") & F.col("open")
        gained, n_next, n_kept = found.agg(
            F.sum(F.when(F.col("retained") & F.col("one"), F.col("size") * F.col("d"))),
            F.count_if(longer) + F.count_if(is_open),
            F.count_if("retained") + F.count_if(F.col("retained") & F.col("one")),
        ).first()
        gained, n_grams = gained or 0.0, n_grams + n_kept
        # the head: what is seen so often; its words are among the common ones
        least = often
        if common_share is None:
            counts = found.where("retained").select(F.explode(F.array("n", F.when(F.col("one"), F.col("size")))).alias("c"))
            least = max(often, _head_from(counts, HEAD_ENTRIES))
        tail = kept.select(F.col("ctx").bitwiseXOR(F.lit(CONTEXT)).alias("key"), F.log10("rest").alias("value"), F.col("size").alias("n"))
        tail = tail.unionByName(found.where("gain is not null").select(F.col("gram").alias("key"), F.col("gain").alias("value"), "n"))
        grams.append(tail.where(F.col("n") < least).select("key", "value"))
        keys, rest = _columns(kept.where(F.col("size") >= least).select("ctx", "rest"))
        order = np.argsort(keys)
        keys, rest = keys[order], rest[order]
        ctx, word, own_mass, own_gain = _columns(found.where("retained").where(F.col("n") >= least).select("ctx", "word", mass.alias("mass"), "gain"))
        both = _find(ctx, keys) * width + _index(word.view(np.uint64), tree.words)
        order = np.argsort(both)
        tree.levels.append(Level(keys, both[order], own_mass[order], rest, own_gain[order]))
        tree.depth, tree.gains = length, [*tree.gains, gained / max(1, n)]
        if length >= min_depth and gained <= least_gain * n:
            break
        # a longer context is a pair of this length; its suffix is a context of this length that is not settled
        keys = F.explode(F.array(F.when(longer, F.col("gram")), F.when(is_open, F.col("ctx").bitwiseXOR(F.lit(CONTEXT)))))
        candidates = _filter(found.select(keys.alias("key")).where("key is not null"), n_next)
        lower = found.select(F.col("gram").alias("below"), "word", F.col("p").alias("q"))
    # what is not in the head
    tree.grams = reduce(DataFrame.unionByName, grams)
    tree.passing = _filter(tree.grams.select("key"), n_grams)
    return tree, vocabulary


def score(docs: DataFrame, tree: SuffixTree, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens: words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased), then one end. score: log10 probability under the tree, each
    token by the longest retained suffix of the words before it. base_score: unigrams with add-one smoothing. The
    logarithm is a sum: that of the token's own share, then for every retained suffix that of what it leaves, and the
    gain of a word that it keeps. So common words and contexts are looked up in the worker; the others, each of which is
    a small share of all tokens, meet the tables by ranges of keys, packed, and go back as sums by document. Null texts are empty;
    every row is a document of its own and has its row in the result, also where ids are null or repeated. Other columns
    are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    levels = [replace(level, mass=level.mass[:0]) for level in tree.levels]
    shared = docs.sparkSession.sparkContext.broadcast(replace(tree, levels=levels, grams=None))
    n_buckets = bucket_count(docs, text_col, SCORE_BUCKET)
    width, missing = bucket_width(n_buckets), math.log10(tree.unknown) if tree.unknown > 0 else -300.0
    parts = "doc_id long, n_tokens long, n_known long, base double, log double"
    schema = arrow_schema(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        states, lefts = max(1, len(tree.words)), [np.log10(level.rest) for level in tree.levels]
        packer = zstandard.ZstdCompressor(level=1)

        def send(key: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(_first(key, doc))
            times = np.diff(np.r_[first, len(key)]).astype(np.uint32)
            key, doc = key[first], doc[first]
            for some, bodies in pack_buckets((key // width).astype(np.int32), [key, doc, times], packer):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(bodies, pa.binary()), pa.nulls(len(some), pa.binary())], ["bucket", "body", "done"]
                )

        rest: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, h, sizes in _chunks(batches, 1, SCORE_TOKENS):
            ids, n_docs = ids.to_numpy(), len(sizes)
            own = np.repeat(np.arange(n_docs), sizes)
            # what depends on the word alone is found once for each of the chunk's words
            word, place = np.unique(h, return_inverse=True)
            index = _index(word, tree.words)
            known = index >= 0
            count = tree.counts[np.maximum(index, 0)] if len(tree.counts) else np.zeros(len(index))
            log = np.where(known, np.log10(np.where(known, tree.root(count), 1.0)), missing)[place]
            base = np.where(known, np.log10(count + 1), 0.0)[place]
            index, known = index[place], known[place]
            # the rest: one entry for each document and word, context or next word
            rest.append((h[~known], ids[own[~known]]))
            for level, left, (at, ctx, both, _) in zip(tree.levels, lefts, _grams(h, sizes, tree.depth), strict=True):
                state = _find(word.view(np.int64), level.keys)[place[at - 1]] if level is tree.levels[0] else _find(ctx.view(np.int64), level.keys)
                here = state >= 0
                log[at[here]] += left[state[here]]
                pair = np.full(len(at), -1)
                asked = np.flatnonzero(here & (index[at] >= 0))
                pair[asked] = _find(state[asked] * states + index[at[asked]], level.pairs)
                log[at[pair >= 0]] += level.gain[pair[pair >= 0]]
                for keys, absent in ((ctx ^ np.uint64(CONTEXT), ~here), (both, pair < 0)):
                    some = np.flatnonzero(absent)
                    some = some[_passes(keys[some].view(np.int64), tree.passing)]
                    rest.append((keys[some], ids[own[at[some]]]))
            sums = [sizes, np.bincount(own, known, n_docs).astype(np.int64), np.bincount(own, base, n_docs), np.bincount(own, log, n_docs)]
            yield wrap(pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *sums)], schema=schema))
            if sum(len(key) for key, _ in rest) >= SCORE_ENTRIES:
                yield from send(*(np.concatenate(c) for c in zip(*rest, strict=True)))
                rest = []
        if rest:
            yield from send(*(np.concatenate(c) for c in zip(*rest, strict=True)))

    def look_up(asked: pa.Table, table: pa.Table) -> pa.Table:
        done = [unpack_table(x.as_py()) for x in asked.column("done") if x.is_valid]
        key, doc, times = unpack_bodies(asked.column("body"), ["u8", "i8", "u4"])
        order = np.argsort(table.column("key").to_numpy())
        at = _find(key.view(np.int64), table.column("key").to_numpy()[order])
        some = np.flatnonzero(at >= 0)  # the filter also lets keys pass that are in no table
        if len(some):
            row = order[at[some]]
            ids, whose = np.unique(doc[some], return_inverse=True)
            c, value = table.column("c").to_numpy()[row], table.column("value").to_numpy()[row]
            sums = [np.bincount(whose, times[some] * x, len(ids)) for x in (c > 0, np.log10(c + 1.0), value)]
            found = [ids, np.zeros(len(ids), np.int64), sums[0].astype(np.int64), *sums[1:]]
            done.append(pa.table([pa.array(x) for x in found], schema=schema))
        return to_groups(done, schema, n_buckets)

    def add_up(table: pa.Table) -> pa.Table:
        found = pa.concat_tables([unpack_table(x.as_py()) for x in table.column("findings")])
        ids, whose = np.unique(found.column(0).to_numpy(), return_inverse=True)
        sums = [np.bincount(whose, found.column(k).to_numpy(), len(ids)) for k in range(1, 5)]
        return pa.table([pa.array(x) for x in (ids, sums[0].astype(np.int64), sums[1].astype(np.int64), *sums[2:])], schema=schema)

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # rows equal in id and text share a key, under which their sums come together; each has its part of them
    keyed = base.select(row_key(base, "id", "text").alias("doc_id"), "id", "text")
    rows = keyed.select("doc_id", "text")
    owners = keyed.groupBy("doc_id").agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    gained = F.log10((F.col("c") - F.lit(tree.discount)) / F.lit(float(max(1, tree.tokens)))) - F.lit(missing)
    # the common words are all that are seen as often as the least of them
    rare = vocabulary.where(F.col("c") < F.lit(int(tree.counts.min()))) if len(tree.counts) else vocabulary
    rare = rare.select(F.col("word").alias("key"), F.col("c").cast("long"), gained.alias("value"))
    table = rare.unionByName(tree.grams.withColumn("c", F.lit(0).cast("long"))).mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays(
                [*b.columns, pa.array((b.column(0).to_numpy().view(np.uint64) // width).astype(np.int32))], ["key", "c", "value", "bucket"]
            )
            for b in batches
        ),
        "key long, c long, value double, bucket int",
    )
    asked = rows.mapInArrow(run, "bucket int, body binary, done binary")
    judged = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(look_up, "group int, findings binary")
    total = F.lit(float(np.log10(tree.tokens + tree.distinct + 1)))
    sums = judged.groupBy("group").applyInArrow(add_up, parts).join(owners, "doc_id")
    part = lambda c: F.col(c) / F.col("copies")
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("id").cast(kind).alias("doc_id"),
        part("n_tokens").cast("long").alias("n_tokens"),
        part("n_known").cast("long").alias("n_known"),
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        (part("base") - part("n_tokens") * total).alias("base_score"),
        part("log").alias("score"),
    )
