import base64
import gzip
import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest
import xxhash

from wayline.llm import exact_search, html_text, kd_shards, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")


def test_pages_come_back_from_archives(spark):
    rows = [(1, "http://a/x y", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é\r\n\r\nWARC/1.1</p>"), (7, "u#page=9", "x" * 100_000), (None, "n", "null id"), (None, "n", "null id"), (9, "h", "HTTP/1.1 no\n\nhead")]
    found = warc.archive_pages(pages(spark, rows)).collect()
    payloads = {i: (h or "").encode() for i, _, h in rows}
    assert Counter(r.page_id for r in found) == Counter(i for i, _, _ in rows)
    for r in found:
        assert r.payload_bytes == len(payloads[r.page_id]) and r.payload_digest == base64.b32encode(hashlib.sha1(payloads[r.page_id]).digest()).decode()
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in found}
    assert kinds[1] == ("revisit", 4) and kinds[4] == ("response", None) and kinds[2] == ("revisit", 3) and kinds[3] == ("response", None) and kinds[None] == ("response", None)
    assert warc.archive_pages(pages(spark, [])).collect() == []


def test_legacy_archives_of_both_versions(spark):
    one = b"filedesc://a 0.0.0.0 20080101000000 text/plain 11\n1 0 test\nX\n\nhttp://a/ 1.2.3.4 200801020304 text/html 5\nhello\n"
    two = b"filedesc://a 0.0.0.0 20080101000000 text/plain - - - - - 11\n2 0 test\nX\n\nhttp://b/ 1.2.3.4 20080102030405 text/html 200 - - 0 a.arc 3\nbye\nbroken line\n"
    got = warc.convert_arcs(spark.createDataFrame([(bytearray(one),), (bytearray(two),), (None,), (bytearray(b"junk"),)], "content binary")).collect()
    assert sorted((r.url, r.payload, r.date) for r in got) == [("http://a/", "hello", "2008-01-02T03:04:00Z"), ("http://b/", "bye", "2008-01-02T03:04:05Z")]
    assert warc.warc_time("2008") == "2008-01-01T00:00:00Z" and warc.warc_time("x") == "1970-01-01T00:00:00Z"


PROSE = "The cat and the dog went to the house of the man who was in the garden with them, and so it is that they are all there. "


def test_main_text():
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div><article><h1>Big&amp;news</h1><p>One <b>two<br>three</b>\n four</p><p>{PROSE}<script>var a='</p>'</script></article><div id=comments><p>{PROSE}</div><footer>&copy; x</footer>"
    assert html_text.main_text(page) == "Big&news\n\nOne two three four\n\n" + PROSE.strip()
    plain = f"<body><div class=menu>{PROSE * 3}</div><h2>Head</h2><p>{PROSE * 3}</p><p>Short.</p><p>{PROSE * 3}</p><ul><li><a href=a>Link one</a></li></ul><form>{PROSE * 3}</form></body>"
    assert html_text.main_text(plain) == "\n\n".join(["Head", (PROSE * 3).strip(), "Short.", (PROSE * 3).strip()])


def test_block_rules_run_on_every_page():
    long = (PROSE * 3).strip()
    links = "".join(f"<li><a href=a>Some other story number {i} of the day that you may like to read as well</a></li>" for i in range(4))
    page = f"<body><h1>Title</h1><article><p>{long}</p><p>Last words.</p><h2>More</h2><ul>{links}</ul></article><p>{long} Outside.</p><div>Imprint</div><footer>{long}</footer>"
    assert html_text.main_text(page) == "\n\n".join(["Title", long, "Last words.", long + " Outside."])
    assert html_text.main_text(f"<nav><a href=a>Home</a></nav><p>{long}</p><p>One.</p><p>Two.</p><footer>c</footer>") == "\n\n".join([long, "One.", "Two."])
    assert html_text.main_text("<nav>Home</nav><h2>Head</h2><p>A short one.</p><p>And another.</p>") == "Head\n\nA short one.\n\nAnd another."
    assert html_text.main_text(f"<p>{long}</p><p>Near the text</p><p>Near the links</p>{links}") == long + "\n\nNear the text"


def test_links_and_neighbours_overrule_containers():
    long, story = (PROSE * 3).strip(), "Some other story of the day that you may like to read as well as this one"
    lists = "".join(f"<p><a href=a>{story}</a></p>" for _ in range(3))
    # Links inside the article go, and short blocks beside them with them; a dense paragraph needs no article.
    assert html_text.main_text(f"<article><p>{long}</p><p>Beside the text</p>{lists}<p>Beside the links</p></article>") == long + "\n\nBeside the text"
    assert html_text.main_text(f"<article><p>{long}</p></article><p>{long} More.</p>") == f"{long}\n\n{long} More."
    # What stands around the article can't be good by its prose alone.
    assert html_text.main_text(f"<article><p>{long}</p></article><aside><p>{long}</p><p>Short</p></aside>") == long


def plain_second_pass(blocks, in_article):
    """Final labels of blocks without headings, by looking for each block's neighbours anew."""
    out = []
    for i, b in enumerate(blocks):
        own = [(abs(j - i), j, x.label) for j, x in enumerate([y for y in blocks if (y.article, y.around) == (b.article, b.around)])]
        place = next(j for j, y in enumerate([y for y in blocks if (y.article, y.around) == (b.article, b.around)]) if y is b)
        before = [(place - j, label) for _, j, label in own if j < place and label in ("good", "bad")][-1:]
        after = [(j - place, label) for _, j, label in own if j > place and label in ("good", "bad")][:1]
        alone = "good" if html_text.points(b, in_article) >= 1 else "bad"
        sides = [label for _, label in before + after]
        if b.label in ("good", "bad"):
            out.append(b.label)
        elif b.label == "near":
            out.append("good" if "good" in sides or not sides and alone == "good" else "bad")
        elif b.label == "far":
            out.append("good" if sides and "bad" not in sides else "bad")
        elif not sides or len(sides) == 2 and sides[0] != sides[1] and before[0][0] == after[0][0]:
            out.append(alone)
        else:
            out.append(min(before + after, key=lambda x: x[0])[1])
    return out


@pytest.mark.parametrize("seed", range(20))
def test_second_pass_equals_plain_search(seed):
    rng = random.Random(seed)
    blocks = []
    for _ in range(rng.randint(1, 40)):
        text = " ".join(rng.choice(["the", "of", "dog", "tree", "walks", "and"]) for _ in range(rng.choice([3, 12, 60])))
        blocks.append(html_text.Block(text=text, linked=rng.choice([0, 0, len(text) // 3, len(text)]), around=rng.random() < 0.3, article=rng.random() < 0.6))
    for b in blocks:
        b.label = html_text._first_pass(b, True)
    html_text._second_pass(blocks, True)
    assert [b.final for b in blocks] == plain_second_pass(blocks, True)
    assert {b.label for b in blocks} <= {"good", "bad", "near", "far", "short"}


@pytest.mark.parametrize("html", [None, "", "<", "<p", "<a href='", "<!--", "<script>", "</p></div>", "a < b > c", "<p>" * 3000, "&#0;&bad;&#x110000;", "<article></article>", "\x00"])
def test_malformed_pages_have_a_text(html):
    assert isinstance(html_text.main_text(html), str)


def test_extract_keeps_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (2, "v", "<article><p>x</p></article>"), (2, "v", "<article><p>x</p></article>")]
    found = html_text.extract(pages(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found) == [(0, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1)]
    assert html_text.extract(pages(spark, [])).collect() == []


def test_shards_are_even_and_keep_groups(documents):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300) + str(i), rng.choice("ab"), f"s{rng.randrange(5)}") for i in range(1500)]
    rows += [(2000 + i, "hot text " * 9, "a", "s0") for i in range(600)] + [(None, None), (None, None), (3000, ""), (3000, "")]
    found = kd_shards.kd_shards(documents(rows), shards=24).collect()
    assert len(found) == len(rows)
    sizes, slots = Counter(), {}
    for r in found:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    hot = {r.shard for r in found if r.doc_id is not None and 2000 <= r.doc_id < 2600}
    assert len(hot) == 1 and len({r.shard for r in found if r.doc_id is None}) == 1
    rest = [n for s, n in sizes.items() if s not in hot]
    assert max(rest) < 1.05 * min(rest)
    assert kd_shards.kd_shards(documents([])).collect() == []
    one = kd_shards.kd_shards(documents([(1, "a")])).collect()
    assert [(r.size, r.slot, r.law) for r in one] == [(9, 0, "bytes")]


def _signed(n):
    return n - (1 << 64) if n >> 63 else n


def _hash(*values):
    """The engine's 64-bit hash of strings and longs, each seeded with the one before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed).intdigest()
    return _signed(seed)


def brute_shards(rows, shards):
    """Shard of each document by plain recursion: weighted medians along the widest of four dimensions."""
    unit = lambda v: _hash(v) % (1 << 20) / (1 << 20)
    low, high = min(r[0] for r in rows), max(r[0] for r in rows)
    points = []
    for i, text, lang, source in rows:
        size = len(text.encode()) + 8
        tie = _hash(_hash(text), zlib.crc32(text.encode())) % (1 << 30)
        points.append((i, size, tie, (unit(lang), unit(source), math.log2(size) / 40, (i - low) / (high - low))))
    out = {}

    def split(own, a, b):
        if a == b:
            out.update((p[0], a) for p in own)
            return
        half = (a + b - 1) // 2
        widths = [max(p[3][d] for p in own) - min(p[3][d] for p in own) for d in range(4)]
        dim = widths.index(max(widths))
        own = sorted(own, key=lambda p: (int(p[3][dim] * ((1 << 30) - 1)), p[2]))
        goal, before, at = sum(p[1] for p in own) * (half - a + 1) / (b - a + 1), 0, 0
        while before + own[at][1] < goal:
            before += own[at][1]
            at += 1
        at += (before + own[at][1] - goal) <= (goal - before)
        split(own[:at], a, half)
        split(own[at:], half + 1, b)

    split(points, 0, shards - 1)
    return out


def test_shards_equal_plain_recursion(documents):
    rng = random.Random(9)
    rows = [(i * 3, "w" * rng.randint(1, 60) + f" {i}", rng.choice(["en", "fr", "de"]), f"s{rng.randrange(5)}") for i in range(1500)]
    for shards in (5, 8):
        found = {r.doc_id: r.shard for r in kd_shards.kd_shards(documents(rows), shards=shards).collect()}
        assert found == brute_shards(rows, shards)


def brute(rows, k):
    out = []
    for q, v in rows:
        if q is None or v is None or q % 3 or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(v, w)))), i) for i, w in rows if i is not None and i != q and w is not None and len(w) == len(v) and all(x is not None and x == x and abs(x) != float("inf") for x in w))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 100, 2**28, 2**40])
def test_search_equals_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(exact_search, "BLOCK_CELLS", 200)
    rng = random.Random(scale)
    rows = [(i, [float(rng.randint(-scale, scale)) for _ in range(20)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + [(300, None), (None, rows[0][1]), (303, [float("nan")] * 20), (306, [None] * 20), (309, [1.0, 2.0]), (312, [2.0, 2.0])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, vector array<double>, rank int")
    found = exact_search.top_k(frame.where("vec_id % 3 = 0"), frame, k=5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute(rows, 5)
    assert exact_search.top_k(frame.limit(0), frame).collect() == []


def test_files_are_plain_warc(spark, tmp_path):
    records = warc.with_revisits(warc.convert_arcs(warc.as_arc(pages(spark, [(1, "http://a/", "hello")]))))
    warc.write_warcs(records, f"{tmp_path}/w")
    content = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    (fields, block), = warc.warc_records(content)
    assert content.startswith(b"WARC/1.1\r\n") and fields["warc-type"] == "response" and block.endswith(b"\r\n\r\nhello") and int(fields["content-length"]) == len(block)


def test_malformed_pages_take_linear_time():
    import time

    for unit in ("</x>", '<a href="x ', "<b></i>", "<!-- x ", "<script> ", "<div class='a"):
        began = time.process_time()
        html_text.main_text(unit * 40_000)
        assert time.process_time() - began < 5


def test_repeated_pages_get_records_of_their_own(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (1, "http://a/", "same"), (2, "http://b/", "same"), (None, "http://c/", "same")]
    path = f"{tmp_path}/w"
    warc.write_warcs(warc.with_revisits(warc.convert_arcs(warc.as_arc(pages(spark, rows)))), path)
    records = [f for p in sorted(tmp_path.glob("w/*.gz")) for f, _ in warc.warc_records(gzip.decompress(p.read_bytes()))]
    ids = [f["warc-record-id"] for f in records]
    assert len(set(ids)) == 4
    response = next(f for f in records if f["warc-type"] == "response")
    assert all(f["warc-refers-to"] == response["warc-record-id"] and f["warc-refers-to-target-uri"] == "http://b/" for f in records if f["warc-type"] == "revisit")
