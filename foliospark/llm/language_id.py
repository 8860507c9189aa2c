"""Operator 9, language identification: scripts narrow the candidates, Viterbi labels the spans of mixed texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed

#: First and last code point of the scripts told apart; any other letter belongs to the script "other".
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
_NAMES = [*SCRIPTS, "other"]
_WORD = re.compile(r"[^\W\d_]+")
#: Slots of the hashed n-gram table and lengths of the n-grams, in code points with word bounds.
SLOTS, GRAMS = 1 << 16, (1, 2, 3, 4)
#: Entries of a worker's word memory; it is emptied when full, which costs time only.
MEMORY_WORDS = 250_000
#: Words whose n-grams (some hundred bytes each, several times) are worked on at once.
GRAM_WORDS = 10_000
#: Words whose Viterbi lattices are worked on at once.
LATTICE_WORDS = 200_000


def script_of(word: str) -> int:
    """Script of a word's first letter that has one."""
    c = ord(word[0])
    for k, ranges in enumerate(SCRIPTS.values()):
        if any(a <= c <= b for a, b in ranges):
            return k
    return len(_NAMES) - 1


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all words, and the word each belongs to."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounded = [f" {w} " for w in words]
    chars = np.frombuffer("".join(bounded).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    own = np.repeat(np.arange(len(words)), [len(w) for w in bounded])
    slots, owners = [], []
    rolled = np.zeros(len(chars), dtype=np.uint64)
    for n in GRAMS:
        # rolled[i] covers the characters i .. i + n - 1
        if n > len(chars):
            break
        rolled = mixed(rolled[: len(chars) - n + 1] * np.uint64(31) + chars[n - 1 :] + np.uint64(n))
        whole = own[: len(rolled)] == own[n - 1 :]
        slots.append((rolled[whole] >> np.uint64(48)).astype(np.int64) & (SLOTS - 1))
        owners.append(own[: len(rolled)][whole])
    return np.concatenate(slots), np.concatenate(owners)


@dataclass
class LanguageModel:
    """Names; log probability of each slot by language; which languages use a script (scripts by languages)."""

    languages: list[str]
    table: np.ndarray
    allowed: np.ndarray


def train(labelled: DataFrame, per_language: int = 4000, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on a bounded sample: about per_language rows of each language, chosen by a hash of the text.

    The n-gram counts are gathered by Spark; at most SLOTS rows a language come to the driver. A language may use a
    script that holds at least 0.1 % of its letters' words in the sample.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                words.setdefault(lang.as_py(), Counter()).update(_WORD.findall(text.as_py().lower()))
            for lang, counter in words.items():
                own = list(counter)
                weight = np.fromiter(counter.values(), np.float64, len(own))
                # log-damped, so that a phrase that is copied often doesn't rule the counts
                damped = 1 + np.log(weight)
                tables.setdefault(lang, np.zeros(SLOTS))
                for at in range(0, len(own), GRAM_WORDS):
                    slots, owners = grams(own[at : at + GRAM_WORDS])
                    tables[lang] += np.bincount(slots, damped[at + owners], SLOTS)
                scripts.setdefault(lang, np.zeros(len(_NAMES)))
                scripts[lang] += np.bincount([script_of(w) for w in own], damped, len(_NAMES)) if own else 0
        for lang, t in tables.items():
            at = np.flatnonzero(t)
            both = np.r_[at, SLOTS + np.arange(len(_NAMES))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(both)), pa.array(both), pa.array(np.r_[t[at], scripts[lang]])], ["lang", "slot", "weight"]
            )

    counted = sample.mapInArrow(count, "lang string, slot long, weight double")
    counted = counted.groupBy("lang", "slot").agg(F.sum("weight").alias("weight")).toPandas()
    languages = sorted(sizes)
    table, scripts = np.full((SLOTS, len(languages)), 0.5), np.zeros((len(_NAMES), len(languages)))
    for k, lang in enumerate(languages):
        own = counted[counted.lang == lang]
        is_gram = (own.slot < SLOTS).to_numpy()
        np.add.at(table[:, k], own.slot.to_numpy()[is_gram], own.weight.to_numpy()[is_gram])
        np.add.at(scripts[:, k], own.slot.to_numpy()[~is_gram] - SLOTS, own.weight.to_numpy()[~is_gram])
    allowed = scripts >= 0.001 * np.maximum(1, scripts.sum(axis=0))
    allowed[~allowed.any(axis=1)] = True  # a script that no language has narrows nothing
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32), allowed)


def word_scores(words: list[str], model: LanguageModel) -> np.ndarray:
    """Log-likelihood of each word by language, relative to the best and at most 8 below; languages that the script
    rules out get 12 below."""
    slots, owners = grams(words)
    scores = np.zeros((len(words), len(model.languages)))
    for k in range(len(model.languages)):
        scores[:, k] = np.bincount(owners, model.table[slots, k], len(words))
    # n-grams overlap: a quarter of their sum is near the evidence of the letters
    scores = (scores - scores.max(axis=1, keepdims=True)) / len(GRAMS)
    scores = np.maximum(scores, -8.0)
    ok = model.allowed[[script_of(w) for w in words]]
    return np.where(ok, scores, -12.0).astype(np.float32)


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word for many documents at once: scores (all words by languages), sizes (words of each
    document, at least 1). A change of language between neighbours costs `penalty`."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    n, k = len(scores), scores.shape[1]
    back = np.zeros((n, k), dtype=np.int16)
    best = scores[starts].astype(np.float64)
    final = np.zeros(len(sizes), dtype=np.int64)
    # documents in order of falling length: those still running are a prefix
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    for t in range(1, int(lengths[0])):
        m = running[t]
        if m < len(best):
            final[m : len(best)] = best[m:].argmax(axis=1)
            best = best[:m]
        at = starts[:m] + t
        top = best.argmax(axis=1)
        high = best[np.arange(m), top][:, None] - penalty
        stay = best >= high
        back[at] = np.where(stay, np.arange(k)[None, :], top[:, None])
        best = np.where(stay, best, high) + scores[at]
    final[: len(best)] = best.argmax(axis=1)
    out = np.zeros(n, dtype=np.int64)
    current = final.copy()
    for t in range(int(lengths[0]) - 1, -1, -1):
        m = running[t]
        at = starts[:m] + t
        out[at] = current[:m]
        if t:
            current[:m] = back[at, current[:m]]
    return out


def identify(
    docs: DataFrame, model: LanguageModel, penalty: float = 6.0, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, spans (array of word interval and language), and the columns of
    `carry` as c0, c1, ..., unchanged.

    Words are runs of letters, lower-cased. A word's script leaves its candidate languages; hashed character
    n-grams score them; Viterbi over the words with a penalty for each change labels the spans. lang_pred is the
    language with the most letters, score its share of all letters. `und` with score 0 for a null text or one without
    a letter, and for all if nothing was learned. Row by row, without a shuffle; repeated rows and null ids are no
    matter; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # SLOTS floats a language
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memory: dict[str, int] = {}
        known = np.zeros((0, len(m.languages)), np.float32)
        letters = np.zeros(0, np.int64)

        def flush(ids: list, words: list[list[str]]) -> pa.RecordBatch:
            nonlocal memory, known, letters
            new = list(dict.fromkeys(w for ws in words for w in ws if w not in memory))
            if len(memory) + len(new) > MEMORY_WORDS:
                memory, known, letters = {}, known[:0], letters[:0]
                new = list(dict.fromkeys(w for ws in words for w in ws))
            if new and m.languages:
                memory.update(zip(new, range(len(memory), len(memory) + len(new)), strict=True))
                known = np.concatenate([known, *[word_scores(new[a : a + GRAM_WORDS], m) for a in range(0, len(new), GRAM_WORDS)]])
                letters = np.r_[letters, np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new), np.int64, len(new))]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            langs, scores, spans = ["und"] * len(words), [0.0] * len(words), [[] for _ in words]
            some = np.flatnonzero(sizes) if m.languages else []
            if len(some):
                index = np.fromiter((memory[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
                path = viterbi(known[index], sizes[some], penalty)
                size, k = letters[index], len(m.languages)
                own = np.repeat(np.arange(len(some)), sizes[some])
                share = np.bincount(own * k + path, size, len(some) * k).reshape(-1, k)
                top = share.argmax(axis=1)
                value = share[np.arange(len(some)), top] / np.maximum(1, share.sum(axis=1))
                bounds = np.r_[np.cumsum(sizes[some]) - sizes[some], len(path)]
                breaks = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (own[1:] != own[:-1])])
                ends = np.r_[breaks[1:], len(path)]
                for d, a, b, q in zip(own[breaks].tolist(), breaks.tolist(), ends.tolist(), path[breaks].tolist(), strict=True):
                    spans[some[d]].append({"start": a - int(bounds[d]), "end": b - int(bounds[d]), "lang": m.languages[q]})
                for d, q, v in zip(some.tolist(), top.tolist(), value.tolist(), strict=True):
                    if v:  # words of other signs only have no letter
                        langs[d], scores[d] = m.languages[q], v
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(langs), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "lang_pred", "score", "spans"]
            )

        def with_rest(batch: pa.RecordBatch, start: int, words: list[list[str]]) -> pa.RecordBatch:
            rows = batch.slice(start, len(words))
            found = flush(rows.column(0), words)
            rest = [rows.column(2 + k) for k in range(len(carry))]
            return pa.RecordBatch.from_arrays([*found.columns, *rest], [*found.schema.names, *[f"c{k}" for k in range(len(carry))]])

        for batch in batches:
            words, start, held = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                words.append(_WORD.findall((text.as_py() or "").lower()))
                held += len(words[-1])
                if held >= LATTICE_WORDS:
                    yield with_rest(batch, start, words)
                    words, start, held = [], k + 1, 0
            if words:
                yield with_rest(batch, start, words)

    rest = "".join(f", c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]]
    return docs.select(*columns).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>{rest}"
    )
