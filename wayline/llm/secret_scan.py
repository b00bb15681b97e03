"""Secret scan with a trigram index.

From each rule's expression follows a Boolean query over trigrams that every match holds. One pass cuts the lower-cased
texts into the trigrams that any rule asks for; the inverted index of these lists the documents of each trigram. A rule
takes the shortest list of each of its conjunctions and intersects it with the others; only the candidates left are
verified by the expression itself. Rules without a mandatory trigram scan all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import cut, stored
from wayline.llm.spans import joined, marked, matches, of_kind

try:  # the parser of expressions in the standard library
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # its place before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

MAX_STRINGS = 64
BUCKETS = 1 << 18


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its Java expression, the same for Python's parser if that differs, the least length of a group."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    plain: str | None = None


# The expressions of known kinds of secrets; the first three are the base kinds.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", group=2, least=6, base=True,
         plain=r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    Rule("access", r"AKIA[A-Z0-9]++", least=20, base=True, plain=r"AKIA[A-Z0-9]+"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", base=True, plain=r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", plain=r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", plain=r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", plain=r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}+", plain=r"[rs]k_live_[0-9A-Za-z]{16,}"),
]

# A query is True (no condition), a trigram, or ("and" | "or", queries).


def _both(kind: str, parts: list):
    """Combine queries, with True absorbed by "and" and absorbing "or"."""
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    if kind == "or":  # a condition that another one implies is enough
        own = [set(p[1]) if not isinstance(p, str) and p[0] == "and" else {p} for p in parts]
        parts = [p for i, p in enumerate(parts) if not any(own[j] < own[i] for j in range(len(parts)))]
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]):
    """The query of a part that matches one of these strings."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op, value) -> set[str] | None:
    """All lower-cased strings that one node of an expression can match, if they are few."""
    if op is sre.LITERAL:
        return {chr(value).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.AT:
        return {""}
    if op is sre.MAX_REPEAT and value[1] == 1:
        inner = _sequence_strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    if op is sre.SUBPATTERN:
        return _sequence_strings(value[-1])
    if op is sre.BRANCH:
        options = [_sequence_strings(x) for x in value[1]]
        return None if any(o is None for o in options) else set().union(*options)
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for op, value in nodes:
        more = _strings(op, value)
        if more is None or len(out) * len(more) > MAX_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _query(nodes):
    """The trigram query of a sequence of nodes: runs of enumerable nodes give strings, the others their own queries."""
    parts, run = [], {""}
    for op, value in nodes:
        more = _strings(op, value)
        if more is not None and len(run) * len(more) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, more)}
            continue
        parts.append(_of_strings(run))
        run = more if more is not None else {""}
        if more is None:
            if op is sre.SUBPATTERN:
                parts.append(_query(value[-1]))
            elif op is sre.BRANCH:
                parts.append(_both("or", [_query(x) for x in value[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                parts.append(_query(value[2]))
    return _both("and", [*parts, _of_strings(run)])


def trigram_query(pattern: str):
    """The Boolean trigram query that every text with a match satisfies; True if none is mandatory."""
    return _query(list(sre_parser.parse(pattern)))


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def conjunctions(query) -> list[frozenset[str]]:
    """A query as alternatives, each of trigrams that must all be there; True has none."""
    if query is True:
        return []
    if isinstance(query, str):
        return [frozenset([query])]
    parts = [conjunctions(q) for q in query[1]]
    if query[0] == "or":
        found = {c for part in parts for c in part}
    else:
        found = {frozenset().union(*chosen) for chosen in product(*parts)}
    return sorted((c for c in found if not any(other < c for other in found)), key=sorted)


def _any_of(trigrams: list[str]) -> str:
    """An expression that finds each place where one of the trigrams begins, parted by their first characters."""
    plain = lambda t: "".join(c if c.isalnum() else f"\\{c}" for c in t)
    firsts = sorted({t[0] for t in trigrams})
    return "(?=(" + "|".join(f"{plain(c)}(?:" + "|".join(plain(t[1:]) for t in trigrams if t[0] == c) + ")" for c in firsts) + "))"


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Rows (trigram, id, digest), those of a trigram together in each file: the inverted index of the trigrams that rules ask for."""
    present = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(trigrams)), F.lit(1)))
    rows = texts.where("text is not null").select(F.explode(present).alias("trigram"), "id", "digest")
    return stored(rows.sortWithinPartitions("trigram"), "postings")


def _candidates(index: DataFrame, queries: dict) -> DataFrame:
    """Rows (id, digest, kinds): the documents that meet the query of a rule, and the kinds of these rules."""
    clauses = [(kind, number, c) for kind, query in queries.items() for number, c in enumerate(conjunctions(query))]
    # One row per trigram of the rules.
    sizes = {r["trigram"]: r["count"] for r in index.groupBy("trigram").count().collect()}
    rows = []
    for i, (kind, _, clause) in enumerate(clauses):
        shortest = min(clause, key=lambda t: (sizes.get(t, 0), t))
        rows += [(t, i, kind, len(clause), t == shortest) for t in sorted(clause)]
    table = index.sparkSession.createDataFrame(rows, "trigram string, clause int, kind string, size int, leads boolean")
    lists = index.join(F.broadcast(table), "trigram")
    shortest, others = lists.where("leads"), lists.where("not leads")
    named = shortest.select(F.col("clause").alias("c"), F.col("id").alias("i"), F.col("digest").alias("d"))
    others = others.join(named, (others["clause"] == named["c"]) & others["id"].eqNullSafe(named["i"]) & (others["digest"] == named["d"]), "left_semi")
    # Equal rows of documents repeat their postings.
    met = shortest.unionByName(others).groupBy("clause", "kind", "size", "id", "digest").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    return met.groupBy("id", "digest").agg(F.collect_set("kind").alias("kinds"))


def _verified(text: Column, rule: Rule, wanted: Column | None = None) -> Column:
    found = matches(text, rule.pattern, rule.group, wanted, context=0)
    return F.filter(found, lambda m: F.length(m["part"]) >= rule.least) if rule.least else found


def find_secrets(documents: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_<kind> of each base kind, base_sha256, spans.

    spans are kind:start:end of all matches of all rules (code points), those of base rules make base_sha256. A null or
    empty text has none. Rows are kept as they come, with null and repeated ids; other columns are ignored; an empty
    table gives no rows.

    Candidates of indexed rules are few; their ids fall into at most BUCKETS buckets, which are broadcast, so that only
    texts in those buckets are shuffled to the exact join. Results are keyed by id and a hash of the text, and documents
    that share both share a result.
    """
    rules = RULES if rules is None else rules
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    queries = {r.kind: trigram_query(r.plain or r.pattern) for r in rules}
    grams = sorted(set().union(*map(trigrams_of, queries.values())))
    indexed = [r for r in rules if queries[r.kind] is not True]
    order = {r.kind: i for i, r in enumerate(rules)}
    everywhere = [marked(_verified(F.col("text"), r), r.kind, order[r.kind]) for r in rules if queries[r.kind] is True]
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    scanned = docs.select("id", "digest", F.concat(none, *everywhere).alias("here"))
    if not indexed:
        return _result(scanned.select(F.col("id").alias("doc_id"), F.col("here").alias("all")), rules)

    candidates = cut(_candidates(postings(docs, grams), {r.kind: queries[r.kind] for r in indexed}))
    bucket = F.pmod(F.col("digest"), F.lit(BUCKETS))
    near = F.broadcast(candidates.select(bucket.alias("bucket")).distinct())
    some = docs.withColumn("bucket", bucket).join(near, "bucket", "left_semi").drop("bucket")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"])
    checked = some.join(candidates, same(some, candidates)).select(
        some["id"], some["digest"], F.concat(none, *[marked(_verified(F.col("text"), r, F.array_contains("kinds", r.kind)), r.kind, order[r.kind]) for r in indexed]).alias("there")
    )
    checked = cut(checked.where(F.size("there") > 0).dropDuplicates(["id", "digest"]))
    spans = scanned.join(checked, same(scanned, checked), "left").select(scanned["id"].alias("doc_id"), F.concat("here", F.coalesce("there", none)).alias("all"))
    return _result(spans, rules)


def _result(spans: DataFrame, rules: list[Rule]) -> DataFrame:
    base = F.filter("all", lambda s: s["kind"].isin([r.kind for r in rules if r.base]))
    counts = [F.size(of_kind(F.col("all"), r.kind)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return spans.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
