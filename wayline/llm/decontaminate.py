"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k = m * error_percent / 100 edits, whatever m is. Of k + 1 pieces of
the item at least one then occurs unchanged; an automaton over all pieces finds those hits in one pass over the text,
and a bit-parallel edit distance verifies the surroundings of each.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM_BYTES = 16 << 20
"""Test items sent to the executors at a time; more items take more passes over the documents."""

_built: dict[str, "Matcher"] = {}


_WORD = re.compile(r"[^\W_]+")


def normalise(text: str | None) -> str:
    """The words (letters and digits) in lower case, one space between them and at both ends; empty without words."""
    words = _WORD.findall((text or "").lower())
    return f" {' '.join(words)} " if words else ""


def closest(masks: dict[str, int], m: int, text: str, start: int, end: int) -> tuple[int, int]:
    """The smallest edit distance of a pattern of m characters to any part of text[start:end], and the first end of such a part.

    masks has, for each character, the bits of its places in the pattern.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, where = m, start
    for j in range(start, end):
        hit = masks.get(text[j], 0)
        carry = hit | minus
        diag = ((((hit & plus) + plus) ^ plus) | hit) & full
        up = minus | (full & ~(diag | plus))
        down = plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = (down | ~(carry | up)) & full
        minus = up & carry
        if score < best:
            best, where = score, j + 1
    return best, where


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], error_percent: int):
        self.items: list[tuple[int | None, int, int, dict[str, int]]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, raw in items:
            text = normalise(raw)
            m = len(text)
            if not m:
                continue
            k = m * error_percent // 100
            cuts = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[text[a:b]].append((len(self.items), a))
            masks: dict[str, int] = defaultdict(int)
            for j, char in enumerate(text):
                masks[char] |= 1 << j
            self.items.append((item_id, m, k, dict(masks)))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, raw: str | None) -> list[tuple[int, int, int]]:
        """(item_id, errors, end in the normalised text) of each item that occurs, by item_id, null first, and errors."""
        text = normalise(raw)
        found: list[tuple[int | None, int, int]] = []
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if self.any and text:
            for last, (size, owners) in self.automaton.iter(text):
                for i, offset in owners:
                    _, m, k, _ = self.items[i]
                    start = last + 1 - size - offset
                    spans[i].append((max(0, start - k), min(len(text), start + m + k)))
        for i, windows in spans.items():
            item_id, m, k, masks = self.items[i]
            windows.sort()
            best, at = k + 1, 0
            start, end = windows[0]
            for a, b in [*windows[1:], (len(text) + 1, 0)]:  # windows that overlap are searched as one
                if a <= end:
                    end = max(end, b)
                    continue
                errors, where = closest(masks, m, text, start, end)
                if errors < best:
                    best, at = errors, where
                start, end = a, b
            if best <= k:
                found.append((item_id, best, at))
        return sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ITEM_BYTES, so that what is broadcast has a bound."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = total // ITEM_BYTES + 1
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()
        yield sorted(((r["id"], r["text"]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def _matcher(key: str, shared, error_percent: int) -> Matcher:
    """The block's matcher, built once in each Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(shared.value, error_percent)
    return _built[key]


def benchmark_hits(
    documents: DataFrame, benchmark: DataFrame, error_percent: int = 6, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document row and test item found in it: doc_id, item_id, errors, end_at.

    Compared are the words in lower case with a space before, between and after them, so an item found without an error
    begins and ends with words. errors is the smallest edit distance of the item to any part of the text, at most
    error_percent of its length (none for the shortest ones), end_at the end of the first such part in the compared
    text. Null texts and texts without words, of documents or items, match nothing; a null doc_id or item_id stays null;
    repeated document rows give repeated hits, repeated item rows none. Other columns are ignored; empty tables give no
    rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    out = None
    for items in _blocks(benchmark, "item_id", "text"):
        shared, key = documents.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared, error_percent)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for hit in matcher.find(text)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                    ["doc_id", "item_id", "errors", "end_at"],
                )

        hits = docs.mapInArrow(run, "doc_id long, item_id long, errors int, end_at long")
        out = hits if out is None else out.unionByName(hits)
    return out


def without_benchmark(documents: DataFrame, benchmark: DataFrame, error_percent: int = 6, text_col: str = "text") -> DataFrame:
    """The document rows in which no test item is found, with all their columns; the rules are those of benchmark_hits."""
    for items in _blocks(benchmark, "item_id", "text"):
        shared, key = documents.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
        place = documents.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key, place=place) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared, error_percent)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(text) for text in batch.column(place).to_pylist()], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
