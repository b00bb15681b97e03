import random
import struct

import pytest

from wayline.sources import container as C
from wayline.sources import structs as S


def build(seed, n=400):
    """A file's bytes and its records (entry, time, payload), with payloads that look like records."""
    rng = random.Random(seed)
    raw, rows = bytearray(C.header("extra")), []
    for e in range(1, 5):
        raw += C.start_record(e, 5, f"s{e}", ["double", "string", "int64[]", "raw"][e - 1], "meta")
    for i in range(n):
        entry = rng.choice([1, 2, 3, 4, 300, 70_000])
        payload = rng.choice([struct.pack("<d", i), b"text", b"", C.record(9, i, b"inner"), C.record(1, 2, b"\0" * 40), b"\0" * rng.randrange(300), rng.randbytes(rng.randrange(2000))])
        ts = rng.choice([i, i * 1000, 2**40 + i])
        raw += C.record(entry, ts, payload)
        rows.append((entry, ts, payload))
    return bytes(raw), rows


@pytest.mark.parametrize("seed", range(4))
def test_any_splits_give_the_same_records(spark, tmp_path, seed):
    raw, rows = build(seed)
    (tmp_path / "log.wpilog").write_bytes(raw)
    whole = None
    for pieces in (1, 7, 41):
        found = C.read_containers(spark, str(tmp_path), -(-len(raw) // pieces)).orderBy("pos").collect()
        data = [(r.entry_id, r.ts_us, bytes(r.payload)) for r in found if r.control is None]
        assert data == rows and [(r.name, r.type, r.metadata) for r in found if r.control == 0] == [(f"s{e}", k, "meta") for e, k in zip(range(1, 5), ("double", "string", "int64[]", "raw"))]
        positions = [r.pos for r in found]
        whole = whole or positions
        assert positions == whole


def test_torn_empty_and_foreign_files(spark, tmp_path):
    raw, rows = build(9, 50)
    (tmp_path / "a.wpilog").write_bytes(raw[:-1] + b"")
    torn = C.read_containers(spark, str(tmp_path / "a.wpilog"), 500).where("control is null")
    assert len(rows) - 1 <= torn.count() <= len(rows)
    (tmp_path / "b.wpilog").write_bytes(C.header())
    assert C.read_containers(spark, str(tmp_path / "b.wpilog")).collect() == []
    (tmp_path / "empty").mkdir()
    assert C.read_containers(spark, str(tmp_path / "empty")).collect() == []
    (tmp_path / "c.wpilog").write_bytes(b"something else entirely")
    with pytest.raises(Exception, match="not a record container"):
        C.read_containers(spark, str(tmp_path / "c.wpilog")).collect()


def test_values_by_type(spark):
    rows = [
        ("boolean", b"\1"), ("int64", struct.pack("<q", -7)), ("float", struct.pack("<f", 0.5)), ("double", struct.pack("<d", 2.5)), ("string", "ä".encode()), ("string", b"\xff"), ("double", b"abc"),
        ("int64[]", struct.pack("<2q", 1, 2)), ("double[]", struct.pack("<2d", 1.5, 2)), ("float[]", struct.pack("<f", 0.25)), ("boolean[]", b"\1\0"), ("struct:Pose2d", b"x" * 32), (None, b"q"), ("double", None), ("double[]", b""),
    ]
    found = C.decoded(spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], "i int, type string, payload binary, extra string")).orderBy("i").collect()
    assert [r.v_bool for r in found[:1]] == [True] and found[1].v_long == -7 and [found[i].v_double for i in (2, 3)] == [0.5, 2.5] and found[4].v_str == "ä"
    assert [bytes(found[i].v_bin) for i in (5, 6, 11, 12)] == [b"\xff", b"abc", b"x" * 32, b"q"]
    assert [found[i].v_longs for i in (7, 10)] == [[1, 2], [1, 0]] and [found[i].v_doubles for i in (8, 9, 14)] == [[1.5, 2.0], [0.25], []]
    assert all(found[13][c] is None for c in ("v_bool", "v_long", "v_double", "v_str", "v_longs", "v_doubles", "v_bin")) and found[0].extra == "clash"


def test_struct_payloads(spark):
    pack = lambda *v: struct.pack(f"<{len(v)}d", *v)
    rows = [(1, pack(1, 2, 0, 1)), (2, pack(1, 2, 3)), (3, struct.pack("<I", 2) + pack(1, 1, 0, 2, 0, -1)), (4, struct.pack("<I", 3) + pack(1, -1, 0)), (5, b"\1"), (6, None)]
    frame = spark.createDataFrame(rows, "i int, raw binary")
    found = {r.i: r for r in frame.select("i", S.pose2d("raw").alias("p"), S.chassis_speeds("raw").alias("c"), S.module_states("raw").alias("m")).collect()}
    assert tuple(found[1].p) == (1, 2, 90.0) and found[2].p.x is None and tuple(found[2].c) == (1, 2, 3) and found[5].c.vx is None and found[6].p.x is None
    assert [tuple(x) for x in found[3].m] == [(1.0, 0.0), (2.0, -90.0)] and [tuple(x) for x in found[4].m] == [(1.0, 180.0)] and found[5].m == [] and found[6].m is None
    both = spark.createDataFrame([([1.0, 0.5, 0.5, 2.0, 1.0, 0.0],)], "v array<double>").select(S.module_states(S.packed(counted=True)("v")).alias("m")).first()
    assert [tuple(x) for x in both.m] == [(1.0, 45.0), (2.0, 0.0)]
