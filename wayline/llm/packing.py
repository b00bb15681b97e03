"""Sequence packing along a space-filling curve.

Documents become vectors of hashed token counts, are projected to three dimensions and sorted by the Hilbert key of
their place, so that neighbours on the curve have similar words. The sorted stream of tokens is cut into sequences.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import mix64, powers, slices, stored

CACHE_UNITS, KEPT_UNITS = 1 << 19, 1 << 17
SLICE_BYTES = 1 << 21
WINDOW = 1 << 19
PARTITION_TOKENS, CHUNK_TOKENS = 1 << 22, 1024
BITS, DIMENSIONS = 16, 3

_LATIN = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_BASE = 0x5851F42D4C957F2D

# Classes of UTF-8 bytes: white space that parts chunks, signs that may end a word, letters. C3 begins most accented ones.
_BLANK, _TAIL, _LETTER = (np.zeros(256, bool) for _ in range(3))
_BLANK[list(b" \t\n\r")] = True
_TAIL[list(b".,;:!?")] = True
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def _byte_chars() -> list[str]:
    """The character that byte-level vocabularies use for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_BYTE_CHARS = _byte_chars()


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64 for one window."""
    return powers(_BASE, WINDOW + 1), powers(pow(_BASE, -1, 2**64), WINDOW + 1)


def _units(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a window's units, and the window with words in lower case.

    Units are chunks between white space; words of Latin letters are parted from the signs after them.
    """
    blank = _BLANK[raw]
    edges = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    letter = _LETTER[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    letter[second] = (raw[second] != 0x97) & (raw[second] != 0xB7)
    # The end of each chunk without its tail: behind the last byte that isn't a sign.
    stem = np.maximum.accumulate(np.where(_TAIL[raw], -1, np.arange(len(raw))))[ends - 1] + 1
    letters = np.concatenate([[0], np.cumsum(letter)])
    word = (stem > starts) & (letters[stem] - letters[starts] == stem - starts)
    cuts = stem[word & (stem < ends)]
    turns = np.zeros(len(raw) + 1, np.int8)
    turns[starts[word]], turns[stem[word]] = 1, -1
    lower = np.where(np.cumsum(turns[:-1], dtype=np.int8).astype(bool) & (raw - np.uint8(65) < 26), raw + np.uint8(32), raw)
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts])), lower


class Encoder:
    """Token ids of texts, made from those of their units.

    This holds for tokenizers that drop white space, never merge across it, and part Latin words from the signs after
    them (what the short ways take for granted is tried with a probe first). A unit's ids are kept by a 64-bit hash of its bytes in sorted arrays, so
    that a window of text is looked up in a few array operations; beyond CACHE_UNITS units the arrays begin anew.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        # Whether words may go to the merge model alone: it does so for a probe of every letter that the short way takes.
        probe = sorted({chr(c).lower() for c in range(256) if _LATIN.fullmatch(chr(c))})
        probe += [x + y for x, y in zip(probe, probe[7:] + probe[:7])]
        capital = [w.upper() for w in probe if _LATIN.fullmatch(w.upper()) and w.upper().lower() == w]
        self.plain = [self._word(w) for w in probe] == self._encode(probe) and self._encode(capital) == self._encode([w.lower() for w in capital])
        tails = [chr(c) for c in range(128) if _TAIL[c]]
        tails += [x + y for x in tails for y in tails]
        whole = self._encode([w + t for w in probe[::9] for t in tails])
        self.parted = whole == [x + y for x in self._encode(probe[::9]) for y in self._encode(tails)]
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.starts, self.sizes, self.pool, self.used = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(1 << 16, self.dtype), 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of one lower-case run of Latin-1 letters, straight from the merge model."""
        if not word.isascii():
            word = "".join(map(_BYTE_CHARS.__getitem__, word.encode()))
        return np.array([t.id for t in self.tokenizer.model.tokenize(word)], self.dtype).tobytes()

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Add units, given with their hashes in ascending order, to the known ones."""
        texts = [u.decode("utf-8", "surrogatepass") for u in units]
        ids = [self._word(t.lower()) if self.plain and _LATIN.fullmatch(t) else None for t in texts]
        odd = [i for i, x in enumerate(ids) if x is None]
        for i, found in zip(odd, self._encode([texts[i] for i in odd])):
            ids[i] = found
        new = np.frombuffer(b"".join(ids), self.dtype)
        sizes = np.array([len(x) // self.dtype.itemsize for x in ids], np.int32)
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used // 2 + 2 * len(new), self.dtype)])
        self.pool[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.hashes, hashes)
        self.slots = np.insert(self.slots, at, np.arange(len(self.starts), len(self.starts) + len(units), dtype=np.int32))
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.concatenate([self.starts, (self.used + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(new)

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[slots] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool[at]

    def _window(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of a window's units, how many ids each has, and the ids."""
        if len(raw) > WINDOW:  # one chunk
            ids = np.frombuffer(self._encode([raw.tobytes().decode("utf-8", "surrogatepass")])[0], self.dtype)
            return np.zeros(1, np.int64), np.array([len(ids)]), ids
        if self.plain and self.parted:
            starts, ends, raw = _units(raw)
        else:
            edges = np.flatnonzero(np.diff(_BLANK[raw], prepend=True, append=True))
            starts, ends = edges[::2], edges[1::2]
        up, down = _powers()
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
            hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        distinct, first, places = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            new = first[~known]
            whole = raw.tobytes()
            self._learn(distinct[~known], [whole[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.hashes, distinct)
        slots = self.slots[at][places]
        return starts, self.sizes[slots], self._ids(slots)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null has none."""
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
        raw = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
        gaps = np.flatnonzero(_BLANK[raw])
        counts, flat, at = np.zeros(len(texts), np.int64), [], 0
        while at < len(raw):
            # Up to the last white space of a window, or to the first one if the window has none.
            last = int(np.searchsorted(gaps, min(at + WINDOW, len(raw)), "left")) - 1
            end = int(gaps[last]) + 1 if last >= 0 and gaps[last] >= at else int(gaps[last + 1]) + 1
            if len(self.starts) > CACHE_UNITS:
                self.clear()
            starts, sizes, ids = self._window(raw[at:end])
            counts += np.bincount(np.searchsorted(begins, starts + at, "right") - 1, sizes, len(texts)).astype(np.int64)
            flat.append(ids)
            at = end
        return np.split(np.concatenate([np.empty(0, self.dtype), *flat]), np.cumsum(counts)[:-1]) if texts else []


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each Python worker: tasks that follow each other there share what is known."""
    return Encoder(path)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with unsigned integer coordinates of so many bits (rows are points).

    The curve's index is found by undoing, from the highest bit down, the exchanges and inversions that each half of
    every axis applies, then turning the result from Gray code to binary and interleaving its bits.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = one << np.uint64(bits - 1)
    while q > one:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - one), flip)
        q >>= one
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


@lru_cache(maxsize=2)
def _signs(vocabulary: int) -> np.ndarray:
    """One 0 or 1 per dimension for each token, the projection of its hash bucket, side by side in fields of 21 bits."""
    buckets = mix64(np.arange(vocabulary, dtype=np.uint64)) % np.uint64(4096)
    bits = mix64(buckets + np.uint64(1 << 20))
    return sum((((bits >> np.uint64(j)) & np.uint64(1)) << np.uint64(21 * j)).astype(np.int64) for j in range(DIMENSIONS))


def _sign_counts(tokens: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """How many tokens project to 1 in each dimension; a field holds the sums of 2**20 tokens."""
    out = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(tokens), 1 << 20):
        packed = int(signs[tokens[at : at + (1 << 20)]].sum())
        out += [(packed >> (21 * j)) & ((1 << 21) - 1) for j in range(DIMENSIONS)]
    return out


def _curve_keys(tokens: list[np.ndarray], vocabulary: int) -> np.ndarray:
    """Hilbert keys of documents from the mean projected sign of their tokens; 0 for documents without tokens."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    signs = _signs(vocabulary)
    counts = np.array([_sign_counts(t, signs) for t in tokens], np.int64).reshape(-1, DIMENSIONS)
    means = 2 * counts / np.maximum(sizes, 1)[:, None] - 1
    cells = ((np.clip(means * 4, -1, 1) + 1) / 2 * ((1 << BITS) - 1)).astype(np.uint64)
    return np.where(sizes > 0, hilbert_keys(cells, BITS), 0)


def _tokenise(path: str, end_id: int):
    """Rows of at most CHUNK_TOKENS ids: a long document has several, so that rows are a fair measure of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        last = np.array([end_id], encoder.dtype)
        vocabulary = encoder.tokenizer.get_vocab_size()
        for batch in (part for b in batches for part in slices(b, "text", SLICE_BYTES)):
            coded = encoder.encode(batch.column("text").to_pylist())
            keys = _curve_keys(coded, vocabulary)
            rows = [(i, start, c[start : start + CHUNK_TOKENS]) for i, c in enumerate(np.append(x, last) for x in coded) for start in range(0, len(c), CHUNK_TOKENS)]
            own = np.array([r[0] for r in rows], np.int64)
            totals = np.array([len(c) + 1 for c in coded], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(own)), batch.column("row").take(pa.array(own)), pa.array(keys[own], pa.int64()), pa.array(totals[own], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary()),
                ],
                CODED.names,
            )
        # What the worker keeps for its next task has a smaller bound, as other stages run in it too.
        if len(encoder.starts) > KEPT_UNITS:
            encoder.clear()
        pa.default_memory_pool().release_unused()

    return run


CODED = pa.schema([*[(name, pa.int64()) for name in ("doc_id", "row", "curve", "doc_tokens", "start")], ("ids", pa.binary())])
PIECE = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(length: int, wide: bool):
    """Cut one partition's stream of documents into sequences; rows of one document that follow each other make one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence, offset = TaskContext.get().partitionId() << 36, 0
        kind = "<u4" if wide else "<u2"
        row, piece = None, None
        for batch in batches:
            out = []
            for doc_id, own, total, start, raw in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "row", "doc_tokens", "start")], batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                at = 0
                while at < len(ids):
                    size = min(len(ids) - at, length - offset)
                    part = ids[at : at + size].tobytes()
                    if piece and row == own and offset and piece[1] + piece[2] == start + at:
                        piece = (doc_id, piece[1], piece[2] + size, zlib.crc32(part, piece[3]), *piece[4:])
                    else:
                        out += [piece] if piece else []
                        row, piece = own, (doc_id, start + at, size, zlib.crc32(part), total, sequence, offset)
                    at, offset = at + size, offset + size
                    if offset == length:
                        sequence, offset = sequence + 1, 0
            yield _pieces(out)
        yield _pieces([piece] if piece else [])

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(len(PIECE.names))], PIECE.names)


def pack(documents: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and end_id; a null or empty text is end_id alone. Sequences hold at most length tokens
    and only the last one of each partition of about PARTITION_TOKENS tokens isn't full. Sequence ids are distinct, not
    consecutive. Rows keep their doc_id, null or repeated; equal documents differ by a row number for the sort. Other
    columns are ignored; an empty table gives no rows.

    Tokens are written once, then range-partitioned and sorted by curve key; as ties are parted by id and row number, a
    large group of equal texts is spread over partitions too, and as long documents are several rows, so are those. No
    partition waits for another.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    wide = _tokenizer(tokenizer_path).get_vocab_size() >= 1 << 16
    coded = stored(docs.mapInArrow(_tokenise(tokenizer_path, end_id), "doc_id long, row long, curve long, doc_tokens long, start long, ids binary"), "tokens")
    total = coded.agg(F.coalesce(F.sum(F.when(F.col("start") == 0, F.col("doc_tokens"))), F.lit(0))).first()[0]
    order = ["curve", "doc_id", "row", "start"]
    dealt = coded.repartitionByRange(max(1, total // PARTITION_TOKENS), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "row", "doc_tokens", "start", "ids").mapInArrow(_pack(length, wide), ", ".join(f"`{n}` long" for n in PIECE.names))
