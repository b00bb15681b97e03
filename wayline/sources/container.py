"""The record container of robot logs: byte-range splits of a file, read side by side.

A file has a header, then records of a bit field, an entry, a payload size and a time in as few bytes as they need, and
the payload. There are no marks between records, so a split finds its first record by itself: it follows every offset of
a window from record to record; chains of offsets that aren't records die or run into the true one, and where all that
live have met is a record. Both neighbours of a border find the same record by this, so no record is lost or read twice.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayline.sources import raw

# What a file begins with, and the kinds of control records (entry 0).
MAGIC = b"WPILOG"
VERSION = 0x0100
START, FINISH, METADATA = 0, 1, 2

WINDOW = 1 << 12
PIECE = 1 << 20
SCHEMA = "path string, pos bigint, entry_id bigint, ts_us bigint, control int, name string, type string, metadata string, payload binary"


def _whole(value: int) -> bytes:
    """A number in as few little-endian bytes as it needs, one at least."""
    return value.to_bytes(max(1, (value.bit_length() + 7) // 8), "little")


def record(entry: int, ts_us: int, payload: bytes) -> bytes:
    """One record."""
    parts = [_whole(entry), _whole(len(payload)), _whole(ts_us)]
    return bytes([(len(parts[0]) - 1) | (len(parts[1]) - 1) << 2 | (len(parts[2]) - 1) << 4]) + b"".join(parts) + payload


def start_record(entry: int, ts_us: int, name: str, kind: str, metadata: str = "") -> bytes:
    """The control record that begins an entry."""
    texts = [t.encode() for t in (name, kind, metadata)]
    return record(0, ts_us, struct.pack("<BI", START, entry) + b"".join(struct.pack("<I", len(t)) + t for t in texts))


def header(extra: str = "") -> bytes:
    raw = extra.encode()
    return MAGIC + struct.pack("<HI", VERSION, len(raw)) + raw


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


class _Bytes:
    """Random access to a file's bytes by pieces."""

    def __init__(self, path: str):
        system, inner = _opened(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.at, self.piece = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from at on, fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.piece):
            self.at, self.piece = at, self.file.read_at(max(n, min(PIECE, max(0, self.size - at))), at) if at < self.size else b""
        return self.piece[at - self.at : at - self.at + n]

    def head(self, at: int) -> tuple[int, int, int, int] | None:
        """(entry, time, payload's place, end) of what would be a record at an offset; None if it can't be one."""
        raw = self.get(at, 17)
        if not raw or raw[0] & 0x80:
            return None
        e, s, t = (raw[0] & 3) + 1, (raw[0] >> 2 & 3) + 1, (raw[0] >> 4 & 7) + 1
        if len(raw) < 1 + e + s + t:
            return None
        size = int.from_bytes(raw[1 + e : 1 + e + s], "little")
        begin = at + 1 + e + s + t
        if begin + size > self.size:
            return None
        return int.from_bytes(raw[1 : 1 + e], "little"), int.from_bytes(raw[1 + e + s : 1 + e + s + t], "little"), begin, begin + size

    def first(self) -> int:
        """Where records begin; raises ValueError if this is no container."""
        raw = self.get(0, 12)
        if len(raw) < 12 or raw[:6] != MAGIC:
            raise ValueError("not a record container")
        return 12 + struct.unpack("<I", raw[8:12])[0]

    def synchronised(self, border: int) -> int:
        """The offset of a record at or behind a border, the same for all who ask; the file's end if there is none."""
        if border <= self.first():
            return self.first()
        window = WINDOW
        while border < self.size:
            ends: dict[int, int | None] = {}
            limit = min(self.size, border + 2 * window)
            for at in range(border, min(self.size, border + window)):
                way, now = [], at
                while now < limit and now not in ends:
                    way.append(now)
                    found = self.head(now)
                    if found is None:
                        now = None
                        break
                    now = found[3]
                end = None if now is None else ends[now] if now in ends else now
                for x in way:
                    ends[x] = end
            alive = {e for e in ends.values() if e is not None}
            if len(alive) == 1:
                return alive.pop()
            if limit == self.size:
                return self.size  # a torn end: what is left belongs to the split before
            window *= 4
        return self.size


class _Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split_bytes = options["path"], int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[_Split]:
        system, inner = _opened(self.path)
        told = system.get_file_info(inner)
        files = [told] if told.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = self.path[: self.path.index(inner)] if inner in self.path else ""
        out = []
        for f in sorted((f for f in files if f.type == fs.FileType.File and not os.path.basename(f.path).startswith((".", "_"))), key=lambda f: f.path):
            out += [_Split(prefix + f.path, a, min(f.size, a + self.split_bytes)) for a in range(0, max(1, f.size), self.split_bytes)]
        return out or [_Split("", 0, 0)]

    def read(self, split: _Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        source = _Bytes(split.path)
        at, stop = source.synchronised(split.start) if split.start else source.first(), source.synchronised(split.end) if split.end < source.size else source.size
        rows: list[tuple] = []
        while at < stop and (found := source.head(at)):
            entry, ts, begin, end = found
            rows.append((split.path, at, *_parsed(entry, ts, source.get(begin, end - begin))))
            at = end
            if len(rows) >= 8192:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


_ARROW = pa.schema([
    ("path", pa.string()), ("pos", pa.int64()), ("entry_id", pa.int64()), ("ts_us", pa.int64()), ("control", pa.int32()), ("name", pa.string()), ("type", pa.string()), ("metadata", pa.string()), ("payload", pa.binary()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _parsed(entry: int, ts: int, payload: bytes) -> tuple:
    """(entry_id, ts_us, control, name, type, metadata, payload): a control record's entry is the one that it speaks of."""
    if entry or len(payload) < 5:
        return entry, ts, None, None, None, None, payload
    kind, about = struct.unpack("<BI", payload[:5])
    texts, at = [], 5
    while at + 4 <= len(payload) and len(texts) < 3:
        n = struct.unpack("<I", payload[at : at + 4])[0]
        texts.append(payload[at + 4 : at + 4 + n].decode("utf-8", "replace"))
        at += 4 + n
    texts += [None] * (3 - len(texts))
    if kind == METADATA:
        texts = [None, None, texts[0]]
    return about, ts, kind, *(texts if kind in (START, METADATA) else [None] * 3), payload


class RecordContainer(DataSource):
    """spark.read.format("record_container").option("splitBytes", n).load(path): one row per record, see SCHEMA.

    path is a file or a folder (files whose names begin with a dot or underscore are passed over) in a store that Arrow
    reads. pos, the record's offset, orders a file's records. control is 0, 1 or 2 for records that start, finish or
    describe an entry, null for data. A file that isn't a container fails; a torn last record is left out; payloads are
    held one at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "record_container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_containers(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(RecordContainer)
    return spark.read.format("record_container").option("splitBytes", split_bytes).load(path)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _opened(folder)
        system.create_dir(inner)
        log, out, entries, done = None, None, {}, []

        def close() -> None:
            if out is not None:
                out.close()
                system.move(f"{inner}/_{log}.part", f"{inner}/{log}.wpilog")
                done.append(log)

        for batch in batches:
            for row_log, ts, name, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("log_id", "ts_us", "name", "type", "payload"))):
                if out is None or row_log != log:
                    close()
                    log, entries = row_log, {}
                    out = system.open_output_stream(f"{inner}/_{log}.part")
                    out.write(header())
                if name not in entries:
                    entries[name] = len(entries) + 1
                    out.write(start_record(entries[name], ts, name, kind))
                out.write(record(entries[name], ts, payload))
        close()
        yield pa.RecordBatch.from_pydict({"log_id": pa.array(done, pa.int64())})

    return run


def little_endian(value: Column) -> Column:
    """The eight bytes of a long."""
    order = [15, 13, 11, 9, 7, 5, 3, 1]
    text = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(text, i, 2) for i in order]))


def named(records: DataFrame) -> DataFrame:
    """Data records with name and type of their entry: path, pos, ts_us, name, type, payload.

    An entry is what the last start record before the data says; the first start of a name in a file settles its type.
    Data before any start of their entry are left out.
    """
    keyed = records.select(F.col("path").alias("log_id"), "entry_id", F.col("pos").alias("at"), "ts_us", "control", "name", "type", "payload")
    starts = keyed.where(F.col("control") == START).select("log_id", "entry_id", F.col("at").alias("ts_us"), F.col("at").alias("seq"), "name", "type")
    data = keyed.where("control is null").select("log_id", "entry_id", F.col("at").alias("ts_us"), F.col("at").alias("seq"), F.col("ts_us").alias("time"), "payload")
    found = raw.resolve(starts, data)
    return found.select(F.col("log_id").alias("path"), F.col("seq").alias("pos"), F.col("time").alias("ts_us"), "name", "type", "payload")


def write_containers(records: DataFrame, folder: str) -> DataFrame:
    """Write a file per log (log_id, ts_us, seq, name, type, payload), in order of time; the logs written. A task that runs again writes its files again."""
    ordered = records.select("log_id", "ts_us", "seq", "name", "type", "payload").repartition("log_id").sortWithinPartitions("log_id", "ts_us", "seq")
    return ordered.mapInArrow(_writer(folder), "log_id long")


# Types of single and of several values, and the bytes that one value takes.
SINGLE = {"boolean": 1, "int64": 8, "float": 4, "double": 8}
SEVERAL = {"boolean[]": 1, "int64[]": 8, "float[]": 4, "double[]": 8}
_FORMS = {"boolean": "?", "int64": "q", "float": "f", "double": "d"}


def _read_value(kind: str | None, raw: bytes | None) -> tuple:
    """(v_bool, v_long, v_double, v_str, v_longs, v_doubles, v_bin); bytes are kept where they can't be read as the type."""
    out: list = [None] * 7
    if raw is None:
        return tuple(out)
    kind = kind or ""
    base = kind.removesuffix("[]")
    try:
        if kind in SINGLE and len(raw) == SINGLE[kind]:
            value = struct.unpack(f"<{_FORMS[kind]}", raw)[0]
            out[{"boolean": 0, "int64": 1}.get(kind, 2)] = value
        elif kind in SEVERAL and len(raw) % SEVERAL[kind] == 0:
            values = list(struct.unpack(f"<{len(raw) // SEVERAL[kind]}{_FORMS[base]}", raw))
            out[4 if base in ("boolean", "int64") else 5] = [int(v) for v in values] if base in ("boolean", "int64") else values
        elif kind in ("string", "json"):
            out[3] = raw.decode("utf-8")
        else:
            out[6] = raw
    except UnicodeDecodeError:
        out[6] = raw
    return tuple(out)


_VALUES = [("v_bool", pa.bool_()), ("v_long", pa.int64()), ("v_double", pa.float64()), ("v_str", pa.string()), ("v_longs", pa.list_(pa.int64())), ("v_doubles", pa.list_(pa.float64())), ("v_bin", pa.binary())]


def decoded(records: DataFrame, type_col: str = "type", payload_col: str = "payload") -> DataFrame:
    """Adds the payload's value in the column of its type, or its bytes in v_bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read_value(k, p) for k, p in zip(batch.column(type_col).to_pylist(), batch.column(payload_col).to_pylist())]
            for i, (name, kind) in enumerate(_VALUES):
                batch = batch.append_column(name, pa.array([r[i] for r in rows], kind))
            yield batch

    added = "v_bool boolean, v_long long, v_double double, v_str string, v_longs array<long>, v_doubles array<double>, v_bin binary"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)
    return records.mapInArrow(run, f"{columns}, {added}")


def kind_of(declared: Column) -> Column:
    """The class of a declared type: itself if it is one of single, several, text or raw types, struct, or unknown."""
    known = F.array(*map(F.lit, [*SINGLE, *SEVERAL, "string", "string[]", "raw"]))
    struct_ = declared.startswith("struct:") | declared.startswith("structschema:")
    return F.when(F.array_contains(known, declared), declared).when(declared == "rawBytes", "raw").when(struct_, "struct").otherwise("unknown")
