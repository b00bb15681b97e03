import hashlib
import zlib

import pytest

from wayline.llm import merkle, queries


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def plain(rows):
    """The same manifest from lists: (doc_id, leaf, subroot, root, proof, folded, verified)."""
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        text = r[1] if not hit or r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        groups.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), r[0], leaf_of(r, r[1]), leaf_of(r, text)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
        return levels

    def way(levels, at):
        for nodes in levels[:-1]:
            start = at // 16 * 16
            run = nodes[start : start + 16]
            yield run[: at - start], run[at - start + 1 :]
            at //= 16

    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: (x[0], x[2], x[3]))]) for g in order}
    top = climb([trees[g][-1][0] for g in order]) if order else []
    out = []
    for j, g in enumerate(order):
        for i, (_, doc_id, leaf, changed) in enumerate(sorted(groups[g], key=lambda x: (x[0], x[2], x[3]))):
            path = [*way(trees[g], i), *way(top, j)]
            value = changed
            for before, after in path:
                value = sha(*before, value, *after)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], sha(*(x for b, a in path for x in (*b, *a))), value, value == top[-1][0]))
    return out


def check(frame, rows):
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, frame.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_equals_plain_trees(spark, documents, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 16**height)
    rows = [(i, f"Text {i}", "en", "hot", 6 + i) for i in range(600)]
    rows += [(1000 + i, f"Text {i}", "en", f"s{i % 20}", 6) for i in range(400)] + [(2000 + i, "A", None, f"lone{i}", 1) for i in range(20)]
    check(merkle.document_manifest(documents(rows)), rows)


@pytest.mark.parametrize("count", [1, 2, 16, 17, 256, 257])
def test_sizes_at_the_edges_of_runs(spark, documents, monkeypatch, count):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, "Ä b", "de", "s", 3) for i in range(count)]
    check(merkle.document_manifest(documents(rows)), rows)


def test_nulls_repeats_and_empty_tables(spark, documents):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "X", "en", "", 1), (5, "", "", "ü", 0), (5, "Y" * 200_000, "en", "ü", 200_000), (9, "é Z", "fr", "z", 3)]
    check(merkle.document_manifest(documents(rows)), rows)
    assert merkle.document_manifest(documents([])).collect() == []


def test_query_on_the_tables(spark):
    frame = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(frame, rows)
