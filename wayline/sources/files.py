"""Log files by name: kinds, start times, buses and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The endings of the four kinds of log files.
KINDS = {".wpilog": "wpilog", ".dslog": "dslog", ".dsevents": "dsevents", ".hoot": "hoot"}

# The forms of file names that tell a start: year, month, day, hour, minute, second.
NAMED = {
    "wpilog": r"FRC_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})\.wpilog$",
    "station": r"(\d{4})_(\d{2})_(\d{2})\s+(\d{2})_(\d{2})_(\d{2})\b.*\.(?:dslog|dsevents)$",
    "rio": r"^rio_(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})\.hoot$",
    "bus": r"^[0-9A-Fa-f]{32}_(\d{4})-(\d{2})-(\d{2})_(\d{2})-(\d{2})-(\d{2})\.hoot$",
}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ending(path: Column) -> Column:
    """The last ending of a path in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def kind(path: Column) -> Column:
    """The kind of log file, null for others."""
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.try_element_at(known, ending(path))


def by_kind(files: DataFrame) -> DataFrame:
    """Rows kind, path of the log files among paths, sorted by kind and path; a range sort, so that no list is gathered."""
    return files.select(kind(F.col("path")).alias("kind"), "path").where("kind is not null").orderBy("kind", "path")


def start_s(path: Column) -> Column:
    """The start that a name tells, in Unix seconds UTC: 0 for a date that doesn't exist, null for names of no known form."""
    name, found = file_name(path), F.lit(None).cast("bigint")
    for form in reversed(NAMED.values()):
        parts = [F.regexp_extract(name, form, i).try_cast("int") for i in range(1, 7)]
        time = F.unix_micros(F.try_make_timestamp(*parts[:5], parts[5].cast("double"), F.lit("UTC")))
        found = F.when(name.rlike(form), F.coalesce(F.floor(time / 1_000_000), F.lit(0))).otherwise(found)
    return found


def bus(path: Column) -> Column:
    """The bus of a device log: rio, its number of 32 digits, or what stands before the first underscore."""
    name = file_name(path)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(name.rlike(NAMED["bus"]), F.left(name, F.lit(32))).when(name.rlike(NAMED["rio"]), "rio").otherwise(F.substring_index(stem, "_", 1))


def label(path: Column, event: str) -> Column:
    """The match that a name tells after the event's name, practice with its time, or the name itself."""
    name = file_name(path)
    match, time = F.regexp_extract(name, rf"{event}_(Q\d+)", 1), F.regexp_extract(name, r"FRC_\d{8}_(\d{6})", 1)
    return F.when(match != "", match).when(time != "", F.concat(F.lit("Practice_"), time)).otherwise(name)
