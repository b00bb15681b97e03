"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are labelled documents, drawn up to a stated number per label. Their terms are words and the beginnings of
longer words, of which those that go with toxicity (by likelihood ratio and lift) make up the vocabulary; inverse document
frequencies count all documents. A document's nearest examples vote by closeness, examples that aren't indexed
calibrate the votes, and the neighbours and terms come along as evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import shingle_set, slices, stored

PREFIXES = (4, 5, 6)
PIECE = 1 << 20
COUNTS = 200_000
BLOCK = 32
EVIDENCE = 3

_WORD = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"\s")


def word_counts(text: str | None) -> Counter:
    """Words of letters in lower case and how often they occur; long texts are done in pieces cut at white space."""
    counts, at, text = Counter(), 0, text or ""
    while at < len(text):
        end = len(text) if at + PIECE >= len(text) else (m.end() if (m := _GAP.search(text, at + PIECE)) else len(text))
        counts.update(_WORD.findall(text[at:end].lower()))
        at = end
    return counts


def terms_of(word: str) -> list[str]:
    """A word's terms: itself, and its first letters with a hyphen where it is longer than they are."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


class Vocabulary:
    """Numbers of terms, found in a text by one automaton; what terms_of() gives for the text's words is what counts."""

    def __init__(self, terms: list[str]):
        self.numbers = {t: i for i, t in enumerate(terms)}
        self._automaton = ahocorasick.Automaton()
        stems: dict[str, list[int | None]] = {}
        for term, i in self.numbers.items():
            stems.setdefault(term.rstrip("-"), [None, None])[term.endswith("-")] = i
        for stem, pair in stems.items():
            self._automaton.add_word(stem, (len(stem), *pair))
        self._automaton.make_automaton()

    def __reduce__(self):
        return Vocabulary, (list(self.numbers),)

    def counts(self, text: str | None) -> dict[int, int]:
        """How often each term of the vocabulary occurs in a text."""
        found: dict[int, int] = {}
        if not text or not self.numbers:
            return found
        text = text.lower()
        for end, (size, whole, longer) in self._automaton.iter(text):
            start, after = end - size, end + 1
            if start >= 0 and _WORD.match(text, start, start + 1):
                continue
            i = longer if after < len(text) and _WORD.match(text, after, after + 1) else whole
            if i is not None:
                found[i] = found.get(i, 0) + 1
        return found


class BlockMaxIndex:
    """Unit vectors in blocks: postings by term and block, and each term's largest weight in each block."""

    def __init__(self, vectors: list[dict[int, float]], terms: int):
        self.size = len(vectors)
        blocks = -(-len(vectors) // BLOCK)
        rows = sorted((t, i, w) for i, v in enumerate(vectors) for t, w in v.items())
        self.docs, self.weights = np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows])
        keys = np.array([r[0] * blocks + r[1] // BLOCK for r in rows], np.int64)
        self.starts = np.searchsorted(keys, np.arange(terms * blocks + 1)).reshape(-1)
        self.most = np.zeros(terms * blocks)
        np.maximum.at(self.most, keys, self.weights)
        self.most = self.most.reshape(terms, blocks)

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the vectors of some blocks that share a term: the terms' postings in these blocks, added up."""
        lists = (terms[:, None] * self.most.shape[1] + blocks[None, :]).ravel()
        starts, sizes = self.starts[lists], self.starts[lists + 1] - self.starts[lists]
        at = np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        sums = np.bincount(self.docs[at], weights=self.weights[at] * np.repeat(np.repeat(weights, len(blocks)), sizes), minlength=self.size)
        hit = np.flatnonzero(sums)
        return hit, np.round(sums[hit], 9)

    def nearest(self, vector: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of all vectors that are at least as near as the k-th nearest one, the nearest first.

        Blocks are visited by falling upper bound, more at a time as they go on, until the bounds are under the k-th best
        cosine, so the answer is exact.
        """
        none = np.empty(0, np.int64), np.empty(0)
        if not vector or not self.size:
            return none
        terms = np.array(sorted(vector))
        weights = np.array([vector[t] for t in terms.tolist()])
        bounds = weights @ self.most[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        places, sims, least, some = [none[0]], [none[1]], 0.0, 2
        while len(order) and bounds[order[0]] + 2e-9 >= least:
            now, order = order[:some], order[some:]
            now = now[bounds[now] + 2e-9 >= least]
            hit, scores = self._scores(terms, weights, now)
            keep = scores >= least
            places.append(hit[keep])
            sims.append(scores[keep])
            best = np.concatenate(sims)
            least = float(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else 0.0
            some *= 4
        places, sims = np.concatenate(places), np.concatenate(sims)
        keep = sims >= least
        places, sims = places[keep], sims[keep]
        order = np.lexsort((places, -sims))
        return places[order], sims[order]


@dataclass
class Model:
    """Bounded by the examples: at most examples_per_label of each label, and vocabulary terms."""

    vocabulary: Vocabulary
    idf: np.ndarray
    k: int
    base: float
    index: BlockMaxIndex | None = None
    toxic: np.ndarray = field(default_factory=lambda: np.empty(0))
    clean: np.ndarray = field(default_factory=lambda: np.empty(0))
    ids: list[int | None] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] = (np.empty(0), np.empty(0))
    blank: float = 0.0

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        """Unit TF-IDF vector: (1 + log of the count) times the inverse document frequency."""
        raw = {t: (1 + math.log(n)) * float(self.idf[t]) for t, n in counts.items()}
        size = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / size for t, w in raw.items()} if size else {}

    def vote(self, vector: dict[int, float]) -> tuple[float, np.ndarray, np.ndarray] | None:
        """The toxic share of the nearest examples' votes, an example's being the larger the nearer it is; None without neighbours."""
        places, sims = self.index.nearest(vector, self.k) if self.index else (np.empty(0, np.int64), np.empty(0))
        if not len(places):
            return None
        near = 1 / (1.05 - sims)
        yes, no = float((self.toxic[places] * near).sum()), float((self.clean[places] * near).sum())
        return yes / (yes + no), places, sims

    def score(self, counts: dict[int, int]) -> tuple[float, list[dict]]:
        """Probability of being toxic and up to EVIDENCE neighbours."""
        found = self.vote(self.vector(counts))
        if found is None:
            return self.blank, []
        vote, places, sims = found
        at = np.searchsorted(self.steps[0], vote, "right") - 1
        score = float(self.steps[1][max(0, at)]) if len(self.steps[0]) else vote
        total = self.toxic + self.clean
        return score, [{"doc_id": self.ids[p], "similarity": float(s), "toxic": float(self.toxic[p] / total[p])} for p, s in zip(places[:EVIDENCE], sims[:EVIDENCE])]


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps (from which vote on, probability) by pooling neighbours that fall; each step shrinks to base by one example."""
    pools: list[list[float]] = []
    for v in np.unique(votes):
        at = votes == v
        pools.append([float(v), float((weights * labels)[at].sum()), float(weights[at].sum())])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, yes, all_ = pools.pop()
            pools[-1][1] += yes
            pools[-1][2] += all_
    return np.array([p[0] for p in pools]), np.array([(p[1] + base * 0.5) / (p[2] + 0.5) for p in pools])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples per term and label, added up over a task as far as memory allows."""
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"term": list(counts), "clean": pa.array([c[0] for c in counts.values()], pa.int64()), "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})
        counts.clear()
        return out

    for batch in batches:
        for part in slices(batch, "text"):
            for text, toxic in zip(part.column("text"), part.column("toxic")):
                label = toxic.as_py()
                for term in {t for w in word_counts(text.as_py()) for t in terms_of(w)}:
                    counts.setdefault(term, [0, 0])[label] += 1
                if len(counts) > COUNTS:
                    yield flush()
    yield flush()


def _frequencies(vocabulary: Vocabulary):
    """Documents of a task that hold each term, and documents in all as term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, np.zeros(len(vocabulary.numbers), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text"):
                    n += 1
                    for t in vocabulary.counts(text.as_py()):
                        found[t] += 1
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"t": pa.array([-1, *held.tolist()], pa.int32()), "n": pa.array([n, *found[held].tolist()], pa.int64())})

    return run


def _vectors(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts = [vocabulary.counts(t.as_py()) for t in part.column("text")]
                lists = lambda items: pa.array(items, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "toxic", "aside")] + [lists([list(c) for c in counts]), lists([list(c.values()) for c in counts])], ["doc_id", "toxic", "aside", "terms", "counts"])

    return run


def _kin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds kin, the smallest hash of a text's word pairs, which nearly equal texts mostly share."""
    for batch in batches:
        for part in slices(batch, "text"):
            least = [int(v[0]) if len(v := shingle_set(t.as_py(), 2)) else 0 for t in part.column("text")]
            yield part.append_column("kin", pa.array(least, pa.int64()))


def draw_examples(documents: DataFrame, labels: DataFrame, examples_per_label: int) -> DataFrame:
    """Rows (doc_id, toxic, text, kin, aside) of at most so many labelled documents of each label, drawn by a hash of their ids.

    Only ids are drawn on the driver's side of the limit. Labels other than 0 and 1 are ignored, repeated labels count
    once, and a document labelled both ways is an example of both. Of rows that share an id, one text counts. kin is
    mostly shared by nearly equal texts. aside marks the quarter that calibrates; kin are on the same side.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples_per_label) for y in (0, 1)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * examples_per_label rows
    texts = documents.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    kin = texts.mapInArrow(_kin, "doc_id long, toxic int, text string, kin long")
    return kin.withColumn("aside", F.pmod(F.xxhash64("kin"), F.lit(4)) == 0)


def _picked(examples: DataFrame, vocabulary_size: int, false_share: float, least_lift: float) -> list[str]:
    """Terms that go with label 1, the strongest by likelihood ratio against independence first.

    Terms of at least three examples are tested, kin being one; as many are picked as keep the expected share of
    chance finds among them under false_share (step-up procedure on the ratios' tail probabilities). Of these, a term must
    be least_lift times as frequent in examples of label 1 as in others, which leaves out what only goes with a language.
    """
    indexed = examples.where("not aside").groupBy("kin", "toxic").agg(F.min("text").alias("text"))
    sizes = {r.toxic: r["count"] for r in indexed.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return []
    terms = indexed.select("text", "toxic").mapInArrow(_term_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = float(sizes[0] + sizes[1])
    held = F.col("clean") + F.col("toxic")
    cells = [(F.col("clean"), held, sizes[0]), (F.col("toxic"), held, sizes[1]), (sizes[0] - F.col("clean"), total - held, sizes[0]), (sizes[1] - F.col("toxic"), total - held, sizes[1])]
    part = lambda seen, row, column: F.when(seen > 0, 2 * seen * F.log(seen * total / (row * column))).otherwise(0.0)
    tested = stored(terms.where(held >= 3).withColumn("g2", F.round(sum((part(*c) for c in cells), F.lit(0.0)), 6)), "terms")
    top = tested.orderBy(F.desc("g2"), "term").limit(vocabulary_size).select("term", "g2", "clean", "toxic").collect()
    tests = tested.count()
    chance = [math.erfc(math.sqrt(max(0.0, r.g2) / 2)) for r in top]
    most = max((i + 1 for i, p in enumerate(chance) if p * tests <= (i + 1) * false_share), default=0) if top else 0
    rate = lambda n, label: (n + 0.5) / (sizes[label] + 1)
    return [r.term for r in top[:most] if rate(r.toxic, 1) >= least_lift * rate(r.clean, 0)]


def learn(documents: DataFrame, labels: DataFrame, examples_per_label: int = 4000, vocabulary_size: int = 4096, false_share: float = 0.01, least_lift: float = 3.0, k: int = 15) -> Model:
    """A model from labels (doc_id, toxic) of documents (doc_id, text); pass it only the labels that it may see.

    Bounds: examples_per_label examples of each label and vocabulary_size terms, the only things that the driver gets.
    Document frequencies count every row of documents, null texts as empty ones. Examples weigh as much as the labelled
    documents that they stand for. Without examples of both labels every score is the share of toxic ones (0 without
    any).
    """
    examples = stored(draw_examples(documents.select("doc_id", "text"), labels, examples_per_label), "examples")
    share = {r.toxic: r["count"] for r in labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct().groupBy("toxic").count().collect()}
    base = share.get(1, 0) / max(1, sum(share.values()))
    vocabulary = Vocabulary(_picked(examples, vocabulary_size, false_share, least_lift))
    if not vocabulary.numbers:
        return Model(vocabulary, np.empty(0), k, base, blank=base)
    counted = documents.select("text").mapInArrow(_frequencies(vocabulary), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    n = {r.t: r.n for r in counted}
    idf = np.array([math.log((1 + n[-1]) / (1 + n.get(t, 0))) + 1e-3 for t in range(len(vocabulary.numbers))])
    model = Model(vocabulary, idf, k, base)
    rows = examples.mapInArrow(_vectors(vocabulary), "doc_id long, toxic int, aside boolean, terms array<int>, counts array<int>").collect()
    drawn = Counter(r.toxic for r in rows)
    weight = {y: share[y] / drawn[y] for y in drawn}
    groups: dict[tuple, list] = {}
    held, blank = [], [0.0, 0.0]
    for r in sorted(rows, key=lambda r: (r.doc_id, r.toxic)):
        counts = dict(sorted(zip(r.terms, r.counts)))
        if not counts:
            blank[r.toxic] += weight[r.toxic]
        elif r.aside:
            held.append((model.vector(counts), r.toxic))
        else:
            group = groups.setdefault(tuple(counts.items()), [r.doc_id, 0.0, 0.0])
            group[1 + r.toxic] += weight[r.toxic]
    # Examples with the same strongest term share blocks, which keeps the blocks' bounds close.
    vectors = sorted(((model.vector(dict(key)), g) for key, g in groups.items()), key=lambda x: (max(x[0], key=lambda t: (x[0][t], -t)), x[1][0]))
    model.index = BlockMaxIndex([v for v, _ in vectors], len(vocabulary.numbers))
    model.ids = [g[0] for _, g in vectors]
    model.clean, model.toxic = np.array([g[1] for _, g in vectors]), np.array([g[2] for _, g in vectors])
    votes = [(v[0], y) for v, y in ((model.vote(x), y) for x, y in held) if v is not None]
    if votes:
        labels_ = np.array([float(y) for _, y in votes])
        model.steps = isotonic(np.round([v for v, _ in votes], 9), labels_, np.array([weight[int(y)] for y in labels_]), base)
    model.blank = (blank[1] + base) / (sum(blank) + 1)
    return model


_SHAPE = "doc_id long, held_out boolean, score double, neighbours array<struct<doc_id:long,similarity:double,toxic:double>>"
_NEIGHBOURS = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.float64())]))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                found = [model.score(model.vocabulary.counts(t.as_py())) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], _NEIGHBOURS)], ["doc_id", "held_out", "score", "neighbours"])

    return run


def score(documents: DataFrame, model: Model, held_out=None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from threshold on) and the nearest examples of every row of documents.

    A text without any term of the vocabulary (null and empty ones, too) has the score that such examples have. Repeated
    rows get equal rows; null ids stay null; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.lit(False).alias("held_out") if held_out is None else F.coalesce(held_out, F.lit(False)).alias("held_out"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    found = rows.mapInArrow(_scores(shared), _SHAPE)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
