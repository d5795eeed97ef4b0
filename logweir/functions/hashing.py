"""Hashes the log's formats need and Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALGORITHMS = ("XxHash3V1",)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


_STEPS = _TABLE.tolist()


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli) of ``data``."""
    crc = 0xFFFFFFFF
    for b in data:
        crc = _STEPS[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def crc32c_many(rows: list[bytes]) -> np.ndarray:
    """CRC-32C of each row; all rows advance a byte at a time together."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    if len(rows) and lengths.max():
        flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        live = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), side="right")
        state = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
        for i, n in enumerate(live):
            s = state[:n]
            state[:n] = _TABLE[(s ^ flat[starts[:n] + i]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        crc[order] = state
    return crc ^ np.uint32(0xFFFFFFFF)


def virtual_shard(key: bytes, shards: int, algorithm: str = "XxHash3V1") -> int:
    """Shard of a key: XXH3-64 with seed 0, unsigned, modulo the number of shards."""
    import xxhash

    if shards <= 0:
        raise ValueError(f"a stream needs at least one virtual shard, not {shards}")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown routing algorithm {algorithm!r}")
    return xxhash.xxh3_64_intdigest(key) % shards


@F.pandas_udf(T.IntegerType())
def route_xxh3(key: pd.Series, shards: pd.Series) -> pd.Series:
    """``virtual_shard`` of binary keys; null where the key is null."""
    return pd.Series([None if k is None else virtual_shard(bytes(k), int(n)) for k, n in zip(key, shards, strict=True)], dtype="Int32")


@F.pandas_udf(T.LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    known = data.notna()
    out = pd.Series([None] * len(data), dtype="Int64", index=data.index)
    if known.any():
        out[known] = crc32c_many([bytes(x) for x in data[known]]).astype(np.int64)
    return out


def route_md5(key: Column, shards: Column) -> Column:
    """A router in built-in functions: the first 32 bits of MD5 modulo the number of shards."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), shards).cast("int")


def bootstrap_id(stream: str, shard: int) -> str:
    """Deterministic migration id of a stream's first assignment, in GUID text form.

    The 16 bytes are laid out as a GUID: its first three fields are little-endian.
    """
    h = hashlib.sha256(f"{stream}:{shard}:bootstrap".encode()).digest()[:16]
    fields = (h[3::-1], h[5:3:-1], h[7:5:-1], h[8:10], h[10:])
    return "-".join(f.hex() for f in fields)


def bootstrap_id_column(stream: Column, shard: Column) -> Column:
    """``bootstrap_id`` in built-in functions."""
    h = F.sha2(F.concat(stream, F.lit(":"), shard.cast("string"), F.lit(":bootstrap")).cast("binary"), 256)
    at = lambda *places: F.concat(*(F.substring(h, 2 * p + 1, 2) for p in places))
    return F.concat_ws("-", at(3, 2, 1, 0), at(5, 4), at(7, 6), at(8, 9), at(10, 11, 12, 13, 14, 15))
