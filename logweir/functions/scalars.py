"""Scalar expressions over messages, headers, names and policies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEAD_LETTER_SUFFIX, MESSAGE_OVERHEAD, MOST_U16

CORRELATION, PROPOSED_BY = "correlation-id", "proposed-by"


def binary(text: str) -> Column:
    return F.encode(F.lit(text), "UTF-8")


def message_size(key: Column, headers: Column, payload: Column) -> Column:
    """Estimated bytes of a buffered message."""
    inside = F.aggregate(headers, F.lit(0).cast("long"), lambda s, h: s + F.octet_length(h["key"]) + F.octet_length(h["value"]))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return F.lit(MESSAGE_OVERHEAD).cast("long") + size(key) + size(payload) + F.coalesce(inside, F.lit(0).cast("long"))


def has_header(headers: Column, name: str) -> Column:
    return F.coalesce(F.exists(headers, lambda h: h["key"] == binary(name)), F.lit(False))


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name; null without one."""
    return F.get(F.filter(headers, lambda h: h["key"] == binary(name)), F.lit(0))["value"]


def default_header(headers: Column, name: str, value: Column) -> Column:
    """``headers`` with ``name`` appended unless it is there already."""
    new = F.struct(binary(name).alias("key"), value.alias("value"))
    return F.when(has_header(headers, name), headers).otherwise(F.concat(F.coalesce(headers, F.array().cast("array<struct<key:binary,value:binary>>")), F.array(new)))


def header_map(headers: Column) -> Column:
    """A client's dictionary view; repeated keys raise."""
    return F.map_from_entries(F.transform(headers, lambda h: F.struct(F.decode(h["key"], "UTF-8"), h["value"])))


def segment_name(offset: Column) -> Column:
    return F.format_string("segment-%020d.sst", offset)


def wal_name(index: Column) -> Column:
    return F.format_string("wal-%020d.log", index)


def number_in_name(path: Column) -> Column:
    """The zero-padded number in a segment or log name."""
    return F.regexp_extract(path, r"(?:segment|wal)-(\d{20})\.(?:sst|log)$", 1).cast("long")


def dead_letter_name(stream: Column) -> Column:
    return F.concat(stream, F.lit(DEAD_LETTER_SUFFIX))


def is_dead_letter(stream: Column) -> Column:
    return F.endswith(stream, F.lit(DEAD_LETTER_SUFFIX))


def request_error(key: Column, headers: Column) -> Column:
    """Why a publish request is refused; null for a sound one."""
    long = F.coalesce(F.exists(headers, lambda h: F.octet_length(h["key"]) > MOST_U16), F.lit(False))
    return F.when(F.octet_length(key) > MOST_U16, "partition key too long").when(F.size(headers) > MOST_U16, "too many headers").when(long, "header key too long")


def group_error(group: Column) -> Column:
    """Why an ack or checkpoint of a consumer group is refused: its name takes the place of the key; null for a sound one."""
    return F.when(F.octet_length(F.encode(group, "UTF-8")) > MOST_U16, "consumer group name too long")


def clamp_duration(us: Column) -> Column:
    return F.greatest(us, F.lit(0).cast("long"))


def clamp_size(size: Column) -> Column:
    return F.when(size >= 0, size)


def retention_cutoff(now: Column, max_us: Column) -> Column:
    """Instant at or before which a message is past its longest retention; never before year 1."""
    limit = F.unix_micros(now) + F.lit(62_135_596_800_000_000)
    return F.timestamp_micros(F.unix_micros(now) - F.least(F.greatest(max_us, F.lit(0).cast("long")), limit))


def enum_or_raise(value: Column, known: list[str], what: str) -> Column:
    return F.when(value.isin(known), value).otherwise(F.raise_error(F.concat(F.lit(f"not a valid {what}: "), F.coalesce(value, F.lit("null")))))


def guid_or_raise(value: Column) -> Column:
    ok = value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
    return F.when(ok, F.lower(value)).otherwise(F.raise_error(F.concat(F.lit("not a valid migration_id: "), F.coalesce(value, F.lit("null")))))


def newer_or_equal(term: Column, index: Column, other_term: Column, other_index: Column) -> Column:
    """Whether the log that ends at ``(term, index)`` is at least as up to date."""
    return F.struct(term.alias("t"), index.alias("i")) >= F.struct(other_term.alias("t"), other_index.alias("i"))
