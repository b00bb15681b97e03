import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wayline.llm import decontaminate, language_id, near_dedup, packing
from wayline.llm.common import shingle_set, word_hashes
from wayline.llm.queries import tokenizer_path

WORDS = {"en": "the of and to in that is was for with".split(), "fr": "le la les des une dans que pour avec sur".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "er", "on"]) for _ in range(n))


def brute_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute_set(text, width):
    words = brute_words(text)
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = ["", " ", "a", "A b\tc\n", "é É\x0bx", "\x1ca b", "a" * 70] + ["".join(rng.choice("aAbÉ \t\n.") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    seen = {}
    for text in texts:
        words = brute_words(text)
        hashes = word_hashes(text).tolist()
        assert len(words) == len(hashes)
        for word, value in zip(words, hashes):
            assert seen.setdefault(word, value) == value
        for width in (2, 5):
            assert len(shingle_set(text, width)) == len(brute_set(text, width))
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_in_pieces():
    text = "alpha " * 200_000 + "b" * (3 << 19) + " alpha"
    hashes = word_hashes(text)
    assert len(hashes) == 200_002 and len(set(hashes.tolist())) == 2


def near_groups(rows, width, percent):
    sets = [(i, brute_set(t, width)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i if i is not None else -1, len(s), low.get(find(k))) for k, (i, s) in enumerate(sets))


def test_near_duplicates_equal_brute_force(documents):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "two words"), (6, "x" * 3000), (None, "two words"), (None, "alone with a null id here")]
    base = [sentence(rng, "en", 60).split() for _ in range(3)]
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, rows[-1][1]), (200, rows[-1][1])]
    for width in (2, 5):
        found = near_dedup.near_duplicates(documents(rows), width=width, percent=80).collect()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in found)
        assert [g[:2] for g in got] == [e[:2] for e in near_groups(rows, width, 80)]
        assert [g for g in got if g[0] >= 0 and g[1]] == [e for e in near_groups(rows, width, 80) if e[0] >= 0 and e[1]]
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_dedup.near_duplicates(documents([])).collect() == []


def test_crowded_lists_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_LIST", 4)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join(passage + [f"u{i}_{j}" for j in range(rng.randint(5, 60))])) for i in range(40)]
    rows += [(100 + i, rows[i][1].replace(f"u{i}_1", "changed")) for i in range(10)]
    found = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(documents(rows), width=2).collect()}
    assert found == {(i, c) for i, _, c in near_groups(rows, 2, 80)}


def test_sets_far_from_their_pivot_send_only_the_part_that_a_link_needs(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_LIST", 4)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"u{i}_{j}" for j in range(rng.randint(25, 40))])) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(f"u{i}_1 ", "changed ")) for i in range(30)]
    sent = spark.sparkContext.accumulator(0)

    def counted(make):
        def made(*args):
            run = make(*args)

            def count(batches):
                for batch in run(batches):
                    sent.add(batch.num_rows)
                    yield batch

            return count

        return made

    for name in ("_full_sets", "_repeated_values", "_rare_parts"):
        if hasattr(near_dedup, name):
            monkeypatch.setattr(near_dedup, name, counted(getattr(near_dedup, name)))
    found = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(documents(rows), width=2).collect()}
    assert found == {(i, c) for i, _, c in near_groups(rows, 2, 80)}
    assert 0 < sent.value <= sum(len(brute_set(t, 2)) for _, t in rows) / 2


def test_any_order_of_the_values_finds_every_pair():
    rng = random.Random(12)
    texts = [" ".join(f"w{j}" for j in rng.sample(range(45), rng.choice([3, 30, 40]))) for _ in range(60)]
    texts += [t.replace("w7 ", "w8 ") for t in texts] + ["one", "one two"]
    sets = [set(shingle_set(t, 1).tolist()) for t in texts]
    batch = pa.RecordBatch.from_pydict({"uid": list(range(len(texts))), "text": texts})
    for common in ([], [1], sorted(set().union(*sets), key=lambda v: sum(v in x for x in sets))[-20:]):
        part = {}
        for out in near_dedup._rare_parts(1, 80, np.array(common, np.int64))(iter([batch])):
            for v, uid, n, place in zip(*[c.to_pylist() for c in out.columns]):
                part.setdefault(uid, []).append(v)
                assert n == len(sets[uid]) and place == len(part[uid]) and v in sets[uid]
        for a in range(len(sets)):
            assert len(part[a]) <= len(sets[a]) / 5 + 1
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    assert set(part[a]) & set(part[b])


def test_repeated_rows_in_crowded_lists_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_LIST", 4)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join(passage + [f"u{i}_{j}" for j in range(rng.randint(5, 60))])) for i in range(40)]
    rows += [(100 + i, rows[i][1].replace(f"u{i}_1", "changed")) for i in range(20)]
    rows += [(None, rows[i][1].replace(f"u{i}_2", "other")) for i in range(20, 24)]
    rows += [r for r in rows for _ in range(5)]
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(documents(rows), width=2).collect())
    assert found == near_groups(rows, 2, 80)


def test_pivots_lose_no_link_among_edited_copies(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT_LIST", 4)
    rng = random.Random(7)
    base, rows = [f"b{i}" for i in range(60)], []
    for i in range(220):
        words = list(base)
        for k in range(rng.choice([0, 1, 2, 4, 8, 8, 12, 20])):
            words[rng.randrange(60)] = rng.choice([f"e{rng.randrange(30)}", f"u{i}_{k}"])
        rows.append((i, " ".join(words + [f"t{i % 50}_{j}" for j in range(rng.choice([0, 0, 0, 40, 90]))])))
    for width in (2, 5):
        found = near_dedup.near_duplicates(documents(rows), width=width).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == near_groups(rows, width, 80)


def test_null_ids_cost_no_pairs_of_rows_and_classes(documents):
    rows = [(None, " ".join(f"w{i}_{j}" for j in range(12))) for i in range(400)] + [(None, " ".join(f"w{i}_{j}" for j in range(11))) for i in range(400)]
    kept = near_dedup.one_of_each(documents(rows), width=2).collect()
    assert len(kept) == 400 and len({r.text.split()[0] for r in kept}) == 400


def test_one_of_each_keeps_columns_and_one_row(documents):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (9, None), (None, "q r s t u v")]
    kept = near_dedup.one_of_each(documents(rows))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 9] and "uid" in kept.columns


def test_language_model_labels_words_and_texts(documents):
    rng = random.Random(4)
    rows = [(i, sentence(rng, lang, 40), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    rows += [(1000, None, "en"), (1001, "", "fr"), (1002, "12 .. 3", None), (None, sentence(rng, "fr", 20), None), (1003, sentence(rng, "en", 5), None)]
    docs = documents(rows)
    model = language_id.learn(docs)
    assert model.labels == ["en", "fr"] and np.all(np.diag(model.transitions) >= model.transitions.max(axis=1) - 1e-6)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows if i is not None and i < 1000)
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "fr" and got[None].held_out is False and got[1003].lang_pred == "en"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got if i is not None)
    mixed = language_id.Labeller(model).label(["the of and les des une"], words=True)[0]
    assert [lang for _, lang in mixed] == ["en"] * 3 + ["fr"] * 3
    assert {r.doc_id for r in language_id.keep_identified(docs, model).collect()} == {i for i in got if got[i].score >= 0.5}
    nothing = language_id.learn(documents([(1, "abc", None)]))
    assert [(r.lang_pred, r.score) for r in language_id.predict(documents([(1, "abc")]), nothing).collect()] == [("und", 0.0)]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    factors, moves = rng.random((5, 3)).astype(np.float32), rng.random((3, 3)).astype(np.float32)
    total = np.zeros((5, 3))
    for path in np.ndindex(*[3] * 5):
        weight = factors[0, path[0]]
        for t in range(1, 5):
            weight *= moves[path[t - 1], path[t]] * factors[t, path[t]]
        for t in range(5):
            total[t, path[t]] += weight
    got = np.zeros((5, 3))
    language_id._chain(factors, np.array([0]), np.array([5]), moves, lambda at, before, after, posterior: got.__setitem__(at, posterior))
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-4)


def edit_distance_to_part(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(6)
    for _ in range(200):
        pattern = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 120)))
        masks = {}
        for j, c in enumerate(pattern):
            masks[c] = masks.get(c, 0) | 1 << j
        assert decontaminate.closest(masks, len(pattern), text, 0, len(text))[0] == edit_distance_to_part(pattern, text)


def test_benchmark_hits_equal_brute_force(spark, documents):
    rng = random.Random(7)
    items = [(i, sentence(rng, "en", 30)) for i in range(6)] + [(6, "Tiny"), (7, None), (None, "no id at all in this one, really"), (8, "")]
    rows = [(0, None), (1, ""), (2, "tiny"), (3, "some tiny thing"), (4, "some tinyish thing")]
    for i in range(60):
        item = list(items[i % 6][1])
        for _ in range(rng.randint(0, 14)):
            item[rng.randrange(len(item))] = rng.choice("xyz")
        rows.append((10 + i, f"{sentence(rng, 'fr', 20)}  {''.join(item).upper()}\n{sentence(rng, 'fr', 9)}"))
    rows += [rows[-1], (None, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.errors) for r in decontaminate.benchmark_hits(documents(rows), benchmark).collect())
    expected = [(2, 6, 0), (3, 6, 0)]
    for i, text in rows:
        for item_id, item in items[:6]:
            m = len(item)
            errors = edit_distance_to_part(decontaminate.normalise(item), decontaminate.normalise(text))
            if text and errors <= m * 6 // 100:
                expected.append((i if i is not None else -1, item_id, errors))
    assert found == sorted(expected)
    clean = decontaminate.without_benchmark(documents(rows), benchmark)
    hit = {f[0] for f in found}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in rows if (i if i is not None else -1) not in hit) and "uid" in clean.columns
    assert decontaminate.benchmark_hits(documents(rows), benchmark.limit(0)).collect() == []


def test_short_items_and_items_without_an_id_are_found(spark, documents):
    rows = [(1, "say (four words and no) more"), (2, "four words and none"), (3, "x" * 40), (4, "other"), (5, "scatter"), (6, "--")]
    benchmark = spark.createDataFrame([(6, "cat"), (10, "--"), (7, "four words and no"), (None, "x" * 40), (8, None), (9, " ")], "item_id long, text string")
    found = decontaminate.benchmark_hits(documents(rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.errors) for r in found) == [(1, 7, 0), (2, 7, 1), (3, None, 0)]
    assert sorted(r.doc_id for r in decontaminate.without_benchmark(documents(rows), benchmark).collect()) == [4, 5, 6]


def test_predictions_equal_enumeration(documents):
    rng = random.Random(21)
    docs = documents([(i, sentence(rng, lang, 40), lang) for i, lang in enumerate(["en", "fr"] * 40)])
    model = language_id.learn(docs)
    rows = [(i, " ".join(rng.choice(WORDS["en"] + WORDS["fr"] + ["12", "xqz"]) for _ in range(rng.randint(1, 7)))) for i in range(40)]
    moves, k = model.transitions.astype(float), len(model.labels)
    got = {r.doc_id: r for r in language_id.predict(documents(rows), model).collect()}
    for i, text in rows:
        words = [w for w in map(language_id._letters, text.lower().split()) if w]
        if not words:
            assert got[i].lang_pred == "und"
            continue
        factors, shares = model.emissions(words).astype(float), np.zeros(k)
        for path in np.ndindex(*[k] * len(words)):
            weight = np.prod([factors[t, y] for t, y in enumerate(path)]) * np.prod([moves[a, b] for a, b in zip(path, path[1:])])
            shares += weight * np.bincount(path, minlength=k)
        shares /= shares.sum()
        assert abs(got[i].score - shares.max()) < 1e-4 and (got[i].lang_pred == model.labels[shares.argmax()] or abs(shares[0] - shares[1]) < 1e-4)


def test_long_texts_are_labelled_in_stretches(monkeypatch):
    rng = np.random.default_rng(6)
    factors, moves = rng.random((70, 3)).astype(np.float32), rng.random((3, 3)).astype(np.float32)
    found = []
    for stretch in (4096, 8):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        got, befores = np.zeros((70, 3)), np.zeros((70, 3))

        def on_word(at, before, after, posterior, got=got, befores=befores):
            got[at] = posterior
            befores[at] = 0 if before is None else before

        language_id._chain(factors, np.array([0, 41]), np.array([41, 29]), moves, on_word)
        found.append((got, befores))
    assert np.allclose(found[0][0], found[1][0]) and np.allclose(found[0][1], found[1][1])


def test_many_languages_share_the_bound(documents):
    rows = [(i, f"some words of {i}", f"l{i % 40}") for i in range(400)] + [(7777, "again and again", "l1")] * 300
    assert len(language_id.learn(documents(rows), docs_in_all=40).labels) == 40


def test_stretches_come_from_the_whole_text(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    frame = spark.createDataFrame([(1, text), (2, "short text")], "k long, t string")
    found = {r.k: r.s for r in frame.select("k", language_id._stretches(frame.t, frame.k, 2000).alias("s")).collect()}
    places = [int(w[1:]) for w in found[1].split()]
    assert found[2] == "short text" and len(found[1]) <= 2020 and max(places) > 12_000 and min(places) < 8000 and set(found[1].split()) <= set(text.split())


def test_code_switched_documents_stay(documents):
    rng = random.Random(3)
    docs = documents([(i, sentence(rng, lang, 40), lang) for i, lang in enumerate(["en", "fr"] * 40)])
    model = language_id.learn(docs)
    mixed = " ".join(f"{sentence(rng, 'en', 12)} {sentence(rng, 'fr', 12)}" for _ in range(4))
    rows = [(1, mixed), (2, "12 34"), (3, None), (4, ""), (5, sentence(rng, "fr", 20)), (5, sentence(rng, "fr", 20))]
    assert sorted(r.doc_id for r in language_id.keep_identified(documents(rows), model).collect()) == [1, 5, 5]


def test_encoder_equals_the_tokenizer():
    rng = random.Random(11)
    encoder = packing.Encoder(tokenizer_path())
    alphabet = "aAbBéÉß÷×.,;:!?- \t\n\r\x0b\x85\xa0\x1c<s>[]@19ñ中😀'\""
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [None, "", "Word, " * 300, "x" * (packing.WINDOW + 9) + " tail."]
    assert encoder.plain and encoder.parted
    assert [c.tolist() for c in encoder.encode(texts)] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_neighbours_on_the_curve_are_packed_together(documents):
    rng = random.Random(12)
    rows = [(i, sentence(rng, "en" if i % 2 else "fr", 60)) for i in range(200)]
    pieces = sorted(packing.pack(documents(rows), tokenizer_path(), length=256).collect(), key=lambda p: (p.sequence_id, p.offset))
    order = [p.doc_id for p in pieces if p.start == 0]
    coded = packing.Encoder(tokenizer_path()).encode([t for _, t in rows])
    keys = packing._curve_keys(coded, packing._tokenizer(tokenizer_path()).get_vocab_size())
    assert [keys[i] for i in order] == sorted(keys)


def test_packing_is_a_round_trip(documents):
    rng = random.Random(8)
    path = tokenizer_path()
    rows = [(1, None), (2, ""), (3, "\x1cone\x1ctwo"), (None, "null id"), (4, "same"), (4, "same"), (5, "a" * 5000)]
    rows += [(10 + i, sentence(rng, "fr", rng.randint(1, 900)) + " Ünïcode, it's 42!") for i in range(30)]
    pieces = packing.pack(documents(rows), path, length=256).collect()
    tokenizer = packing._tokenizer(path)
    wanted = {}
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        wanted.setdefault(i, []).append(ids)
    for i, lists in wanted.items():
        own = [p for p in pieces if p.doc_id == i]
        assert sum(p.length for p in own) == sum(map(len, lists))
        for p in own:
            ids = next(x for x in lists if len(x) == p.doc_tokens)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(sum(n for _, n in s) < 256 for s in by_sequence.values()) == 1
    assert packing.pack(documents([]), path).collect() == []


def test_hilbert_neighbours_touch():
    grid = np.array(list(np.ndindex(8, 8, 8)))
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_parities_bound_the_difference():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 500, rng.integers(0, 300))) * 7919 * 512 for _ in range(2))
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in near_dedup._parities(a) ^ near_dedup._parities(b))
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0
