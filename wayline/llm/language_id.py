"""Language identification by a linear-chain conditional random field over words.

Each word has affix, character n-gram and lexicon features; transitions between the languages of neighbouring words
are learned with them. Forward-backward gives every word of a text a distribution over languages, so code-switched
texts are labelled word by word; a document's language is the one with the largest expected share of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 14
CACHE_WORDS = 200_000
STRETCH = 4096
LANE_WORDS = 1 << 19

_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint64)


def _letters(chunk: str) -> str:
    """The letters of a chunk of text in lower case."""
    return chunk if chunk.isalpha() else "".join(c for c in chunk if c.isalpha())


def _features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, one after the other, and where each word's begin.

    Five families share one table: lexicon entries come first, then hashed bigrams and trigrams with the word's ends
    marked, prefixes and suffixes of one to three bytes.
    """
    parts = [f"^{w}$".encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    raw = np.frombuffer(b"".join(parts) + b"\0\0\0", np.uint8).astype(np.uint64)
    with np.errstate(over="ignore"):
        two = (raw[:-1] * np.uint64(257) + raw[1:] + np.uint64(1)) * _MIX[0]
        three = ((raw[:-2] * np.uint64(257) + raw[1:-1]) * np.uint64(257) + raw[2:] + np.uint64(7)) * _MIX[1]
        affixes = []
        for n in (1, 2, 3):
            code = sum(raw[np.minimum(starts + j, ends - 1)] * np.uint64(257**j) for j in range(1, n + 1))
            affixes.append((code + np.uint64(n)) * _MIX[2])
            code = sum(raw[np.maximum(ends - 1 - j, starts)] * np.uint64(257**j) for j in range(1, n + 1))
            affixes.append((code + np.uint64(n)) * _MIX[3])
    fold = lambda x: ((x >> np.uint64(16)) % np.uint64(BUCKETS)).astype(np.int64)
    base = len(lexicon) + 1
    # Rows per word: its grams (one of each kind for each byte but the last), six affixes, one lexicon entry.
    counts = 2 * (sizes - 1) - 1 + 7
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int64)
    byte_word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - starts[byte_word]
    is_two, is_three = place < sizes[byte_word] - 1, place < sizes[byte_word] - 2
    out[(begin[byte_word] + place)[is_two]] = base + fold(two[: len(place)][is_two])
    out[(begin[byte_word] + sizes[byte_word] - 1 + place)[is_three]] = base + BUCKETS + fold(three[: len(place)][is_three])
    tail = begin + counts - 7
    for j, codes in enumerate(affixes):
        out[tail + j] = base + 2 * BUCKETS + (j % 2) * BUCKETS + fold(codes)
    out[tail + 6] = [lexicon.get(w, len(lexicon)) for w in words]
    return out, begin


@dataclass
class Model:
    """Labels, lexicon and weights; small enough to broadcast: the tables have 4 * BUCKETS + lexicon rows."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Positive factors of each word for each label, the largest being 1."""
        flat, begin = _features(words, self.lexicon)
        scores = np.add.reduceat(self.weights[flat], begin, axis=0) if len(words) else np.empty((0, len(self.labels)))
        return np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32) if len(words) else scores.astype(np.float32)


def _chain(factors: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray, on_word) -> None:
    """Forward-backward over many sequences side by side, the longest first.

    on_word(positions, before, after, posterior) gets, for each step from the last to the first, the places of the
    words at it, the forward state of the word before (None at the first) with the backward state, and the posterior.
    Forward states are kept for one stretch of STRETCH steps and for the starts of the others, from which they are made
    again, so memory besides the factors grows with a small part of the longest sequence.
    """
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")

    def onwards(state: np.ndarray | None, t: int) -> np.ndarray:
        a = active[t]
        f = factors[starts[:a] + t]
        state = f.copy() if state is None else (state[:a] @ moves) * f
        return state / state.sum(axis=1, keepdims=True)

    corners: list[np.ndarray | None] = []  # the state before each stretch
    forward: list[np.ndarray] = []
    state = None
    for t in range(steps):
        if t % STRETCH == 0:
            corners.append(state)
            forward = []
        state = onwards(state, t)
        forward.append(state)
    back = None
    for stretch in range(len(corners) - 1, -1, -1):
        first = stretch * STRETCH
        if stretch < len(corners) - 1:
            forward, state = [], corners[stretch]
            for t in range(first, first + STRETCH):
                state = onwards(state, t)
                forward.append(state)
        for t in range(first + len(forward) - 1, first - 1, -1):
            a = active[t]
            now = np.ones((a, moves.shape[0]), np.float32)
            if back is not None:
                now[: len(back)] = back
            posterior = forward[t - first] * now
            posterior /= posterior.sum(axis=1, keepdims=True)
            f = factors[starts[:a] + t] * now
            before = forward[t - first - 1] if t > first else corners[stretch]
            on_word(starts[:a] + t, None if before is None else before[:a], f, posterior)
            back = f @ moves.T
            back /= back.sum(axis=1, keepdims=True)


def fit(texts: list[tuple[str, str]], lexicon_words: int = 400, lane: int = 256, rounds: int = 40, rate: float = 0.15) -> Model:
    """Train on (language, text) pairs: a word's label is its document's language.

    Documents are cut into stretches of 20 to 60 words, dealt out at random into sequences with changing languages, so
    that transitions are learned from switched text. The lexicon has each language's most frequent words.
    """
    labels = sorted({lang for lang, _ in texts})
    rng = np.random.default_rng(17)
    vocabulary: dict[str, int] = {}
    counts = [Counter() for _ in labels]
    stretches = []
    for lang, text in texts:
        words = [w for w in map(_letters, text.lower().split()) if w]
        counts[labels.index(lang)].update(words)
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
        at = 0
        while at < len(ids):
            step = int(rng.integers(20, 61))
            stretches.append((labels.index(lang), ids[at : at + step]))
            at += step
    k = len(labels)
    lexicon = {w: i for i, w in enumerate(sorted({w for c in counts for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]}))}
    weights = np.zeros((len(lexicon) + 1 + 4 * BUCKETS, k), np.float32)
    moves = np.full((k, k), -2.0, np.float32)
    np.fill_diagonal(moves, 0.0)
    if k < 2 or not vocabulary:
        return Model(labels, lexicon, weights, np.exp(moves))
    order = rng.permutation(len(stretches))
    tokens = np.concatenate([stretches[i][1] for i in order])
    gold = np.concatenate([np.full(len(stretches[i][1]), stretches[i][0]) for i in order])
    # Languages count alike, however many words they have.
    share = np.bincount(gold, minlength=k) / len(gold)
    weight = (1 / np.maximum(share, 1e-9) / k).astype(np.float32)[gold]
    starts = np.arange(0, len(tokens), lane)
    sizes = np.minimum(lane, len(tokens) - starts)
    flat, begin = _features(list(vocabulary), lexicon)
    spans = np.diff(np.append(begin, len(flat)))
    first = np.zeros(len(tokens), bool)
    first[starts] = True
    pairs = np.zeros((k, k), np.float64)
    inside = np.flatnonzero(~first)
    np.add.at(pairs, (gold[inside - 1], gold[inside]), 1)
    memory, memory_moves = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(rounds):
        scores = np.add.reduceat(weights[flat], begin, axis=0)
        factors = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float32)[tokens]
        posteriors, expected = np.empty((len(tokens), k), np.float32), np.zeros((k, k))
        table = np.exp(moves - moves.max())

        def on_word(at, before, after, posterior, posteriors=posteriors, expected=expected, table=table):
            posteriors[at] = posterior
            if before is not None:
                norm = np.einsum("ni,ij,nj->n", before, table, after)
                expected += table * np.einsum("ni,nj,n->ij", before, after, 1 / norm)

        _chain(factors, starts, sizes, table, on_word)
        posteriors[np.arange(len(tokens)), gold] -= 1
        posteriors *= weight[:, None]
        gradient = np.empty_like(weights)
        for j in range(k):
            per_word = np.bincount(tokens, posteriors[:, j], minlength=len(vocabulary))
            gradient[:, j] = np.bincount(flat, np.repeat(per_word, spans), minlength=len(weights))
        gradient = gradient / len(tokens) + 1e-6 * weights
        step = ((expected - pairs) / len(tokens)).astype(np.float32)
        memory += gradient**2
        memory_moves += step**2
        weights -= rate * gradient / np.sqrt(memory)
        moves -= rate * step / np.sqrt(memory_moves)
    return Model(labels, lexicon, weights, np.exp(moves - moves.max()))


def _stretches(text: Column, key: Column, most: int, pieces: int = 20) -> Column:
    """A text of at most so many characters whole; of a longer one as many characters, in stretches drawn by hash from all over it and cut at white space."""
    size = most // pieces
    at = lambda i: F.pmod(F.xxhash64(key, i), F.length(text) - size + 1).cast("int") + 1
    drawn = F.transform(F.sequence(F.lit(1), F.lit(pieces)), lambda i: F.regexp_replace(F.substring(text, at(i), F.lit(size)), r"^\S*\s|\s\S*$", ""))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(drawn, " "))


def learn(documents: DataFrame, docs_per_language: int = 150, chars_per_doc: int = 20_000, docs_in_all: int = 76_800) -> Model:
    """Fit on a bounded sample of the labelled documents whose crc32 remainder isn't 2.

    At most docs_per_language different documents of each language are drawn by a hash of id, language and text, fewer
    where there are so many languages that this would be more than docs_in_all (but at least one), and at most
    chars_per_doc characters of each, in stretches from the whole text; this bound is all that the driver sees of the
    corpus. Repeated rows count once. Only text and lang of those rows are used. All languages are learned.
    """
    own = documents.select(F.col("doc_id").alias("id"), "text", "lang").where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = own.groupBy("lang").count().collect()  # one row for each language
    if not sizes:
        return Model([], {}, np.zeros((4 * BUCKETS + 1, 0), np.float32), np.zeros((0, 0), np.float32))
    scale, each = 1 << 30, max(1, min(docs_per_language, docs_in_all // len(sizes)))
    limits = {r["lang"]: min(scale, scale * (4 * each + 8) // r["count"]) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])[F.col("lang")]
    key = F.xxhash64("id", "lang", "text")
    drawn = own.withColumn("key", key).where(F.pmod("key", F.lit(scale)) < limit).select("lang", "key", _stretches(F.col("text"), F.col("key"), chars_per_doc).alias("text")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(scale)), "key", "text"))  # some four times as many as stay
    chosen = drawn.withColumn("nr", first).where(F.col("nr") <= each).collect()
    return fit(sorted((r["lang"], r["text"]) for r in chosen))


def held_out(doc_id) -> F.col:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Labeller:
    """Labels batches of texts with a model, keeping the factors of words seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.factors = np.empty((1024, len(self.model.labels)), np.float32)
        self.used = 0

    def _learn_words(self, chunks: list[str]) -> None:
        letters = [_letters(c) for c in chunks]
        known = [i for i, w in enumerate(letters) if w]
        for i in range(len(chunks)):
            self.places[chunks[i]] = -1
        for at in range(0, len(known), 50_000):
            part = known[at : at + 50_000]
            rows = self.model.emissions([letters[i] for i in part])
            if self.used + len(rows) > len(self.factors):
                grown = np.empty((2 * (self.used + len(rows)), self.factors.shape[1]), np.float32)
                grown[: self.used] = self.factors[: self.used]
                self.factors = grown
            self.factors[self.used : self.used + len(rows)] = rows
            self.places.update((chunks[i], self.used + j) for j, i in enumerate(part))
            self.used += len(rows)

    def label(self, texts: list[str | None], words: bool = False) -> list[tuple[str, float, float]] | list[list[tuple[str, str]]]:
        """(language, score, certainty) of each text; with words, the labelled words of each text instead.

        score is the language's expected share of the words, certainty the mean of what each word's likeliest label has.
        """
        out: list = [[] if words else ("und", 0.0, 0.0) for _ in texts]
        if not self.model.labels:
            return out
        waiting, size = [], 0
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
        for i in order:
            chunks = texts[i].lower().split()
            if len(self.places) > CACHE_WORDS:
                if waiting:
                    self._run(waiting, out, words)
                    waiting, size = [], 0
                self.clear()
            missing = set(chunks).difference(self.places)
            if missing:
                self._learn_words(sorted(missing))
            ids = np.fromiter(map(self.places.__getitem__, chunks), np.int32, len(chunks))
            if words:
                chunks = [c for c, at in zip(chunks, ids) if at >= 0]
            ids = ids[ids >= 0]
            if len(ids):
                waiting.append((i, ids, chunks if words else None))
                size += len(ids)
            if size >= LANE_WORDS:
                self._run(waiting, out, words)
                waiting, size = [], 0
        if waiting:
            self._run(waiting, out, words)
        return out

    def _run(self, waiting: list, out: list, words: bool) -> None:
        waiting = sorted(waiting, key=lambda x: -len(x[1]))
        sizes = np.array([len(x[1]) for x in waiting])
        starts = np.cumsum(sizes) - sizes
        factors = self.factors[np.concatenate([x[1] for x in waiting])]
        sums, sure = np.zeros((len(waiting), factors.shape[1]), np.float64), np.zeros(len(waiting))
        best = np.empty(len(factors), np.int64) if words else None

        def on_word(at, before, after, posterior):
            sums[: len(at)] += posterior
            sure[: len(at)] += posterior.max(axis=1)
            if best is not None:
                best[at] = posterior.argmax(axis=1)

        _chain(factors, starts, sizes, self.model.transitions.astype(np.float32), on_word)
        shares = sums / sums.sum(axis=1, keepdims=True)
        for k, (i, ids, chunks) in enumerate(waiting):
            if words:
                out[i] = [(c, self.model.labels[j]) for c, j in zip(chunks, best[starts[k] : starts[k] + sizes[k]])]
            else:
                top = int(shares[k].argmax())
                out[i] = (self.model.labels[top], min(1.0, float(shares[k][top])), min(1.0, float(sure[k] / sizes[k])))


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    score is the expected share of words in lang_pred. A text that is null, empty or without a letter is und with
    score 0, as is every text if nothing could be learned. Predictions look at the text only; rows are kept as they
    come, repeated ones and null ids included. Ties go to the first language in alphabetical order.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            found = labeller.label(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: Model, least_certainty: float = 0.5) -> DataFrame:
    """The document rows, with all their columns, whose words are labelled with at least this certainty on average.

    What counts is each word's own label, so a text that switches between languages stays. Null and empty texts and those
    without a letter go; repeated rows go or stay alike; an empty table stays empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            found = labeller.label(batch.column(place).to_pylist())
            yield batch.filter(pa.array([x[0] != "und" and x[2] >= least_certainty for x in found], pa.bool_()))
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    return documents.mapInArrow(run, documents.schema)
