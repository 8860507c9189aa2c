"""Operator 1, SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = "▁"
_MARK_BYTES = _MARK.encode()
_NONE = float("inf")
#: Symbols from here on are characters that are no pieces.
_CHARS = 1 << 17
#: Entries of a worker's word memory; it is emptied when full, which costs time only.
MEMORY_WORDS = 600_000


class PieceCodec:
    """Encoder and decoder for a SentencePiece BPE model with identity normalisation, dummy prefix and byte fallback.

    Text is cut where no piece can reach across: before a mark (escaped blank) that follows another character. Each
    such word is encoded once by the agenda below and remembered. The library is used only to read the vocabulary
    and to check the results.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib, n = self.library, self.library.get_piece_size()
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.normal: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.surface.append(b" \xe2\x81\x87 " if lib.is_unknown(i) else b"")
            else:
                self.normal[piece] = i
                self.cost[piece] = -lib.get_score(i)
                self.surface.append(piece.replace(_MARK, " ").encode())
        if any(_MARK in p.lstrip(_MARK) for p in self.normal):
            raise ValueError("pieces that hold a mark after another character can't be cut into words")
        if n > 65536 or len(self.byte_ids) != 256:
            raise ValueError("needs byte fallback and at most 65,536 pieces")
        self.byte_set = frozenset(self.byte_ids.values())
        self.words: dict[bytes, bytes] = {}
        self._pair_table()

    def _pair_table(self) -> None:
        """All adjacent pairs that join into a piece: sorted keys, joined symbol and cost. Symbol: piece id, or a
        character's number above all pieces where it is no piece itself."""
        self.symbol_of_char = np.arange(0x110000, dtype=np.int64) + _CHARS
        for piece, i in self.normal.items():
            if len(piece) == 1:
                self.symbol_of_char[ord(piece)] = i
        number = lambda s: self.normal[s] if s in self.normal else ord(s) + _CHARS if len(s) == 1 else -1
        keys, joined = [], []
        for piece, i in self.normal.items():
            for k in range(1, len(piece)):
                left, right = number(piece[:k]), number(piece[k:])
                if left >= 0 and right >= 0:
                    keys.append(left << 32 | right)
                    joined.append(i)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array([*keys, -1], dtype=np.int64)[[*order, -1]]
        self.pair_joined = np.array([*joined, -1], dtype=np.int64)[[*order, -1]]
        cost = np.array([self.cost.get(self.library.id_to_piece(i), _NONE) for i in range(len(self.surface))])
        self.pair_cost = np.append(cost, _NONE).astype(np.float32)[self.pair_joined]

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pair table (or its last row) and cost."""
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys[:-1], key)
        at[self.pair_keys[at] != key] = len(self.pair_keys) - 1
        return at, self.pair_cost[at]

    def merge_many(self, words: list[str]) -> list[bytes]:
        """Ids of many words as little-endian 16-bit numbers. One agenda for each word, popped in step: the
        best-scored adjacent pair of every word first, the leftmost of equal ones."""
        out: list[bytes] = [b""] * len(words)
        small = [k for k, w in enumerate(words) if 0 < len(w) <= 32]
        if small:
            sizes = np.fromiter((len(words[k]) for k in small), np.int64, len(small))
            chars = np.frombuffer("".join([words[k] for k in small]).encode("utf-32-le"), dtype="<u4")
            ends = np.cumsum(sizes)
            symbols = np.full((len(small), int(sizes.max()) + 1), -1, dtype=np.int64)
            symbols[np.repeat(np.arange(len(small)), sizes), np.arange(len(chars)) - np.repeat(ends - sizes, sizes)] = (
                self.symbol_of_char[chars]
            )
            rows = np.arange(len(small))  # of those that may still merge
            work = symbols
            places, costs = self._pair(work[:, :-1], work[:, 1:])
            while len(rows):
                best = costs.argmin(axis=1)
                live = costs[np.arange(len(rows)), best] < _NONE
                if not live.all():
                    symbols[rows[~live], : work.shape[1]] = work[~live]
                    symbols[rows[~live], work.shape[1] :] = -1
                    rows, work, places, costs, best = rows[live], work[live], places[live], costs[live], best[live]
                    if not len(rows):
                        break
                at = np.arange(len(rows))
                joined = self.pair_joined[places[at, best]]
                later = np.arange(work.shape[1] - 1)[None, :] > best[:, None]
                work = np.where(later, work[:, 1:], work[:, :-1])
                work[at, best] = joined
                later = later[:, :-1]
                places = np.where(later, places[:, 1:], places[:, :-1])
                costs = np.where(later, costs[:, 1:], costs[:, :-1])
                if not costs.shape[1]:
                    costs = np.full((len(rows), 1), _NONE, dtype=np.float32)
                    places = np.full((len(rows), 1), len(self.pair_keys) - 1)
                    continue
                for k in (best, best - 1):
                    some = (k >= 0) & (k < costs.shape[1])
                    r, c = at[some], k[some]
                    places[r, c], costs[r, c] = self._pair(work[r, c], work[r, c + 1])
            known = symbols < _CHARS
            plain = known.all(axis=1)
            counts = (symbols >= 0).sum(axis=1)
            flat = symbols[(symbols >= 0) & plain[:, None]].astype("<u2").tobytes()
            stop = 0
            for j, k in enumerate(small):
                if plain[j]:
                    stop += 2 * int(counts[j])
                    out[k] = flat[stop - 2 * int(counts[j]) : stop]
        for k, w in enumerate(words):
            if w and not out[k]:
                out[k] = self._bytes(self._long_agenda(list(w)))
        return out

    def _bytes(self, parts: list[str]) -> bytes:
        ids: list[int] = []
        for s in parts:
            ids += [self.normal[s]] if s in self.normal else [self.byte_ids[b] for b in s.encode()]
        return np.array(ids, dtype="<u2").tobytes()

    def _long_agenda(self, parts: list[str]) -> list[str]:
        """The agenda as a heap over linked symbols; entries are stale once either side has changed."""
        symbols: list[str | None] = [*parts]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []

        def propose(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            if joined in self.cost:
                heapq.heappush(agenda, (self.cost[joined], left, right, joined))

        for k in range(n - 1):
            propose(k, k + 1)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right:
                continue
            if symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                propose(left, after[left])
            if before[left] >= 0:
                propose(before[left], left)
        return [s for s in symbols if s is not None]

    def cut(self, text: bytes) -> list[bytes]:
        """Words of a non-empty text. A word stands for itself after one mark, or, when it begins with a line feed
        (which no piece holds), for itself alone. Runs of marks stay on the word that follows them."""
        parts = text.replace(_MARK_BYTES, b" ").replace(b"\n", b" \n").split(b" ")
        if b"" not in parts:
            return parts
        words, held = [], 0
        for k, p in enumerate(parts):
            if p[:1] == b"\n":
                # the blank before it is only the cut; marks in front of it are a word of their own
                if held:
                    words.append(b" " * (held - 1))
                    held = 0
                words.append(p)
            elif p:
                words.append(b" " * held + p)
                held = 0
            else:
                held += 1
        if held:
            words.append(b" " * (held - 1))
        return words

    def learn(self, words: list[bytes]) -> None:
        """Encodes unknown words and checks all of them against the library in one call."""
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if len(self.words) + len(new) > MEMORY_WORDS:
            self.words.clear()
            new = list(dict.fromkeys(words))
        texts = [w.decode() for w in new]
        own = self.merge_many([t.replace(" ", _MARK) if t[:1] == "\n" else _MARK + t.replace(" ", _MARK) for t in texts])
        lone = self.normal[_MARK]
        for w, t, ids, ref in zip(new, texts, own, self.library.encode(texts, num_threads=1), strict=True):
            if t[:1] == "\n":  # the library puts its dummy prefix before it
                same = ref[0] == lone and ids == np.array(ref[1:], "<u2").tobytes()
            else:
                same = ids == np.array(ref or [lone], "<u2").tobytes()
            if not same:
                raise ValueError(f"the library encodes {t!r} differently")
            self.words[w] = ids

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian 16-bit numbers, without begin and end ids."""
        cut = [self.cut(t) if t else [] for t in texts]
        missing: list[bytes] = []
        done: list[bytes] = []
        start = 0
        # blocks of words keep what has to be learned at once small against the memory
        for k, words in enumerate(cut):
            missing += [w for w in words if w not in self.words]
            if len(missing) > MEMORY_WORDS // 8 or k == len(cut) - 1:
                self.learn(missing)
                missing = []
                for ws in cut[start : k + 1]:
                    try:
                        done.append(b"".join(map(self.words.__getitem__, ws)))
                    except KeyError:  # the memory was emptied meanwhile
                        self.learn(ws)
                        done.append(b"".join(map(self.words.__getitem__, ws)))
                start = k + 1
        return done

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the dummy prefix goes, runs of byte pieces are decoded as UTF-8, each broken byte as U+FFFD."""
        out, surface = bytearray(), self.surface
        try:
            joined = b"".join(map(surface.__getitem__, ids))
            out += joined[1:] if self._starts_with_mark(ids) else joined
            return out.decode()
        except UnicodeDecodeError:
            return self.library.decode(ids)

    def _starts_with_mark(self, ids: list[int]) -> bool:
        for i in ids:
            if self.surface[i]:
                return i != self.unk and i not in self.byte_set and self.surface[i].startswith(b" ")
        return False


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """The worker's codec for a model, built once."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


def _batches(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a text column of about so many bytes (or one text): (first row, texts)."""
    start, size, texts = 0, 0, []
    for k, t in enumerate(column.cast(pa.large_binary())):
        t = t.as_py() or b""
        texts.append(t)
        size += len(t)
        if size >= most:
            yield start, texts
            start, size, texts = k + 1, 0, []
    if texts:
        yield start, texts


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_bos: bool = True, add_eos: bool = True
) -> DataFrame:
    """One row per document: doc_id, ids (array<int>), decoded (text of these ids).

    Exactly the library's ids, with begin and end ids as asked. Null and empty texts have these alone and decode to
    an empty text. Works row by row, without a shuffle; repeated rows and null ids are no matter; other columns are
    not read. model_path is a file that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for batch in batches:
            for start, texts in _batches(batch.column(1)):
                ids, decoded = [], []
                for e in c.encode_batch(texts):
                    own = [*([c.bos] if add_bos else []), *np.frombuffer(e, dtype="<u2").tolist(), *([c.eos] if add_eos else [])]
                    ids.append(own)
                    decoded.append(c.decode(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>, decoded string"
    )


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_pieces() with begin and end ids, then decode; per document n_tokens, ids_sha256, decoded_sha256.

    Digests are made in the worker, so that ids and texts don't travel back to the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        first, last = np.array([c.bos], "<u4"), np.array([c.eos], "<u4")
        for batch in batches:
            for start, texts in _batches(batch.column(1)):
                n, sha, back = [], [], []
                for e in c.encode_batch(texts):
                    ids = np.concatenate([first, np.frombuffer(e, dtype="<u2").astype("<u4"), last])
                    n.append(len(ids))
                    sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    back.append(hashlib.sha256(c.decode(ids.tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
