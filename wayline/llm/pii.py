"""Personal data by candidate boosting.

Exact rules give the base spans. Looser generators propose further, overlapping spans; boosted trees score them by
format and context, and a threshold per kind, calibrated on documents that trees weren't grown on, selects more spans.
The trees learn from labels that don't ask the exact rules: check digits, octets, digit counts and announcing words of
the candidate, its separators and written-out signs made plain first.
All features are small whole numbers, so what is learned from is a table of counts per combination of features: it
covers every document, yet has at most as many rows as there are combinations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.spans import digits_of, joined, marked, matches, of_kind, outermost, passes_luhn

KINDS = ["email", "ip", "card", "phone"]

# The base expressions. Their runs are entered at the start only, which finds the same matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The generators of candidates.
CANDIDATES = {
    "email": r"(?<![\w.@%+-])[\w.%+-]++(?:@|\x20?[\[(](?i:at)[\])]\x20?)[\w-]++(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[\w-]++)*+",
    "ip": r"(?<![\w.:])(?:[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![\w.])|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:]))",
    "card": r"(?<![0-9])[0-9](?:[\x20._-]{0,2}+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,2}+[0-9]){7,14}+(?![0-9A-Za-z])",
}
# Words that announce each kind.
HINTS = {
    "email": r"(?i)(e-?mail|contact|correo|courriel|write|mail)\W*$",
    "ip": r"(?i)(\bip|address|host|server|adresse)\W*$",
    "card": r"(?i)(card|visa|credit|karte|carte|tarjeta|account|konto)\W*$",
    "phone": r"(?i)(phone|tel|call|fax|mobile|handy|móvil|appel)\w*\W*$",
}

FEATURES = {"length": 5, "marks": 4, "before": 3, "after": 3, "hint": 2, "variety": 3, "check": 2}
"""Features and how many values each has, from 0."""

TREES = 12
PRECISION = 0.95
SURE = 1.645
"""How many standard deviations the precision's lower bound lies below what was counted."""

_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_IPV6 = r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"
_EMAIL = r"^[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}+$"


def base_spans(text: Column) -> dict[str, Column]:
    """The base matches of each kind, failing ones dropped."""
    digits = lambda m: F.length(digits_of(m["text"]))
    has_at, has_digit = text.contains("@"), text.rlike("[0-9]")
    small = lambda m: F.forall(F.split(m["text"], r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.when(F.ltrim(p, F.lit("0")) == "", 0), F.lit(256)) <= 255)
    return {
        "email": matches(text, BASE["email"], wanted=has_at),
        "ip": F.filter(matches(text, BASE["ip"], wanted=has_digit), small),
        "card": F.filter(matches(text, BASE["card"], wanted=has_digit), lambda m: digits(m).between(14, 19) & passes_luhn(digits_of(m["text"]))),
        "phone": F.filter(matches(text, BASE["phone"], wanted=text.contains("+")), lambda m: digits(m).between(10, 15)),
    }


def _step(value: Column, limits: list[int]) -> Column:
    """How many of the limits a number reaches."""
    out = F.lit(0)
    for i, x in enumerate(limits):
        out = F.when(value >= x, F.lit(i + 1)).otherwise(out)
    return out


def _check(m: Column, kind: str) -> Column:
    """Whether a candidate passes the test that its kind has for itself: check digit, octets, a domain of two parts, a number of digits."""
    digits = digits_of(m["text"])
    if kind == "card":
        return F.length(digits).between(13, 19) & passes_luhn(digits)
    if kind == "ip":
        return m["text"].rlike(_IPV4) | m["text"].rlike(_IPV6)
    return m["text"].rlike(r"(?i)[.\])]\x20?[A-Za-z]{2,}$") if kind == "email" else F.length(digits).between(10, 15)


def least_precision(good: float, bad: float) -> float:
    """Lower confidence bound of a share of good ones (score interval); 0 where nothing was counted."""
    n = good + bad
    if not n:
        return 0.0
    p, z = good / n, SURE * SURE
    return (p + z / (2 * n) - SURE * math.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)


def _valid(m: Column, kind: str) -> Column:
    """The label of a candidate: whether it is right as data of its kind, however it is written."""
    body, digits, announced = m["text"], digits_of(m["text"]), m["before"].rlike(HINTS[kind])
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(body, r"\x20?[\[(](?i:at)[\])]\x20?", "@"), r"\x20?[\[(](?i:dot)[\])]\x20?", ".")
        return plain.rlike(_EMAIL)
    if kind == "ip":
        return body.rlike(_IPV4) | body.rlike(_IPV6)
    if kind == "card":
        return F.length(digits).between(13, 19) & passes_luhn(digits)
    # Numbers without the sign of an international one are phones where a word says so.
    abroad = body.rlike(r"^(?:\+|00)") & F.length(F.regexp_replace(digits, "^00", "")).between(10, 15)
    return ~body.rlike(_IPV4) & (abroad | announced & F.length(digits).between(7, 15))


def _candidate(m: Column, kind: str) -> Column:
    """A candidate with its features and its label."""
    body = m["text"]
    size = F.length(body) if kind in ("email", "ip") else F.length(digits_of(body))
    marks = F.length(F.regexp_replace(body, r"[\w]", ""))
    edge = lambda c, first: F.when(F.length(c) == 0, F.lit(0)).when(c.rlike(r"\s$" if first else r"^\s"), F.lit(1)).otherwise(F.lit(2))
    kinds_of_char = F.size(F.array_distinct(F.split(F.regexp_replace(body, r"[^\w]", ""), "")))
    return F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        _step(size, [8, 12, 16, 24]).alias("length"), _step(marks, [1, 2, 4]).alias("marks"),
        edge(m["before"], True).alias("before"), edge(m["after"], False).alias("after"),
        m["before"].rlike(HINTS[kind]).cast("int").alias("hint"), _step(kinds_of_char, [4, 8]).alias("variety"), _check(m, kind).cast("int").alias("check"),
        _valid(m, kind).alias("good"),
    )


def candidates(text: Column) -> dict[str, Column]:
    """The generators' spans of each kind with their features."""
    asked = {"email": text.rlike(r"@|[\[(](?i:at)[\])]"), "ip": text.rlike("[0-9A-Fa-f][.:][0-9A-Fa-f]")}
    digits = text.rlike("[0-9]")
    return {k: _featured(matches(text, CANDIDATES[k], wanted=asked.get(k, digits)), k) for k in KINDS}


def _featured(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: _candidate(m, kind))


def _overlaps(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


@dataclass
class Model:
    """Trees of each kind, as (feature, limit, feature, limit, four leaf values), and the kind's threshold on their sum."""

    trees: dict[str, list[tuple]]
    thresholds: dict[str, float]


def _leaf(tree: tuple, x: dict) -> int:
    a, la, b, lb = tree[:4]
    return 2 * (x[a] > la) + (x[b] > lb)


def _grow(rows: list[tuple[dict, float, float]]) -> list[tuple]:
    """Boost trees of two splits on (features, positives, negatives) by Newton steps of the logistic loss."""
    splits = [(f, v) for f, n in FEATURES.items() for v in range(n - 1)]
    positive, negative = sum(r[1] for r in rows), sum(r[2] for r in rows)
    start = math.log((positive + 1) / (negative + 1))
    scores, trees = [start] * len(rows), [("length", -1, "length", -1, (start,) * 4)]
    for _ in range(TREES):
        slopes = []
        for (x, p, n), s in zip(rows, scores):
            q = 1 / (1 + math.exp(-s))
            slopes.append((p * (1 - q) - n * q, (p + n) * q * (1 - q)))
        best = None
        for i, (a, la) in enumerate(splits):
            for b, lb in splits[i:]:
                sums = [[0.0, 1.0] for _ in range(4)]
                for (x, _, _), (g, h) in zip(rows, slopes):
                    cell = sums[2 * (x[a] > la) + (x[b] > lb)]
                    cell[0] += g
                    cell[1] += h
                gain = sum(g * g / h for g, h in sums)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, (a, la, b, lb, tuple(0.3 * g / h for g, h in sums)))
        trees.append(best[1])
        scores = [s + best[1][4][_leaf(best[1], x)] for (x, _, _), s in zip(rows, scores)]
    return trees


def learn(documents: DataFrame, text_col: str = "text") -> Model:
    """Count candidates of all documents by their features, grow trees on four fifths of them and calibrate on the rest.

    A kind's threshold is the lowest score from which on PRECISION of the calibration part's candidates have a good label,
    and from which on the lower confidence bound of that share, among those that no base span covers, which are the
    ones to be added, reaches PRECISION, too; kinds without such a score get no further spans. So some fifty right
    candidates must have been seen before any is added. Where the calibration part has no candidate of a kind, the
    others calibrate it.
    """
    text = F.col("text")
    rows = documents.select(F.col(text_col).alias("text")).where("text is not null")
    # One row of all matches per text, made once: what follows refers to them several times.
    found = F.struct(
        F.pmod(F.xxhash64("text"), F.lit(5)).alias("part"), *[b.alias(f"b_{k}") for k, b in base_spans(text).items()], *[c.alias(f"c_{k}") for k, c in candidates(text).items()]
    )
    bases = rows.select(F.inline(F.array(found)))

    def judged(kind: str) -> Column:
        """The candidates of a kind but those over base spans of other kinds only, which are never added."""
        others = F.concat(*[F.col(f"b_{o}") for o in KINDS if o != kind])
        own = F.filter(f"c_{kind}", lambda c: _overlaps(F.col(f"b_{kind}"), c) | ~_overlaps(others, c))
        return F.transform(own, lambda c: F.struct(F.lit(kind).alias("kind"), (~_overlaps(F.col(f"b_{kind}"), c)).alias("more"), c["good"].alias("good"), *[c[f].alias(f) for f in FEATURES]))

    each = bases.select("part", F.inline(F.concat(*map(judged, KINDS))))
    # At most the product of all features' numbers of values, times 4 kinds, 2 parts and 2 sorts, whatever the corpus.
    table = (
        each.groupBy("kind", (F.col("part") == 0).alias("held"), "more", *FEATURES)
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()
    )
    model = Model({}, {})
    for k in KINDS:
        grown = [({f: r[f] for f in FEATURES}, r["good"], r["bad"], r["more"]) for r in table if r["kind"] == k and not r["held"]]
        held = [({f: r[f] for f in FEATURES}, r["good"], r["bad"], r["more"]) for r in table if r["kind"] == k and r["held"]]
        grown, held = grown or held, held or grown
        if not any(r[1] for r in grown):
            continue
        grown.sort(key=lambda r: (sorted(r[0].items()), r[3]))
        trees = _grow([r[:3] for r in grown])
        scored = sorted(((sum(t[4][_leaf(t, x)] for t in trees), p, n, more) for x, p, n, more in held), key=lambda s: -s[0])
        counts = {True: [0, 0], False: [0, 0]}
        for i, (score, p, n, more) in enumerate(scored):
            counts[more][0] += p
            counts[more][1] += n
            good, bad = (counts[True][j] + counts[False][j] for j in (0, 1))
            sure = good >= PRECISION * (good + bad) and least_precision(*counts[True]) >= PRECISION
            if (i + 1 == len(scored) or scored[i + 1][0] < score) and sure:
                model.thresholds[k] = score
        if k in model.thresholds:
            model.trees[k] = trees
    return model


def _score(c: Column, trees: list[tuple]) -> Column:
    out = F.lit(0.0)
    for a, la, b, lb, (ll, lr, rl, rr) in trees:
        out = out + F.when(c[a] > la, F.when(c[b] > lb, F.lit(rr)).otherwise(F.lit(rl))).otherwise(F.when(c[b] > lb, F.lit(lr)).otherwise(F.lit(ll)))
    return out


def _all_spans(text: Column, model: Model) -> tuple[Column, Column]:
    """Base spans of all kinds, and the further ones that the model selects, none of which touches a base span."""
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    base = F.concat(none, *[marked(b, k, KINDS.index(k)) for k, b in base_spans(text).items()])
    if not model.trees:
        return base, none
    more = [marked(_selected(c, model.trees[k], model.thresholds[k]), k, KINDS.index(k)) for k, c in candidates(text).items() if k in model.trees]
    return base, F.concat(none, *more)


def _selected(found: Column, trees: list[tuple], threshold: float) -> Column:
    return F.filter(found, lambda c: _score(c, trees) >= threshold - 1e-9)


def _spans(documents: DataFrame, model: Model, text_col: str) -> DataFrame:
    """All columns with base_ and more_, arrays of spans."""
    base, more = _all_spans(F.col(text_col), model)
    rows = documents.withColumns({"base_": base, "more_": more})
    return rows.withColumn("more_", F.filter("more_", lambda c: ~_overlaps(F.col("base_"), c)))


def find_personal_data(documents: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_<kind> (base spans), base_sha256, spans.

    spans are kind:start:end of base and selected spans (code points), the base ones alone make base_sha256. A null or
    empty text has none. Rows are kept as they come, with null and repeated ids; other columns are ignored; an empty
    table gives no rows. Without a model it is learned from the documents. Each row is judged by itself: no shuffle.
    """
    model = learn(documents, text_col) if model is None else model
    rows = _spans(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, "text")
    counts = [F.size(of_kind(F.col("base_"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base_")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base_", "more_")).alias("spans"))


def redact(documents: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets; n_chars follows the text.

    Overlapping spans are replaced once, by the kind of the first. Null texts stay null. All columns are kept.
    """
    model = learn(documents, text_col) if model is None else model
    rows = _spans(documents, model, text_col)
    text = F.col(text_col)
    ordered = F.array_sort(F.concat("base_", "more_"))
    rows = rows.withColumn("spans_", F.when(F.size("base_") + F.size("more_") > 0, outermost(ordered)))
    pieces = F.transform("spans_", lambda s: F.concat(F.substring(text, s["from"] + 1, s["start"] - s["from"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring(text, F.array_max(F.transform(ordered, lambda s: s["end"])) + 1, F.length(text))
    new = F.when(F.col("spans_").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    rows = rows.withColumn(text_col, new).drop("base_", "more_", "spans_")
    return rows.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in rows.columns else rows
