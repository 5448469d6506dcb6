"""Packed binary reads, for exchange with tools that write them; Parquet is the engine's own format.

A record is a header of six bytes (payload size, 24 bits; whether it has qualities, 1 bit; bases, 23 bits) and a
payload.  Bases are runs of up to four equal letters: a symbol of 7 bits holds the run less one (2 bits) and the
letter (5 bits, A is 1).  A byte holds a symbol's xor with the one before; its top bit says that the same xor follows
once more.  Qualities are runs of up to 256: one byte for a single value, else two with the run less one in the low 7
bits of the first and the top bit of the second, whose other bits are the value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 6
RECORD = "header string, seq string, qual string"


def _runs(text: str, most: int) -> Iterator[tuple[str, int]]:
    for letter, same in groupby(text):
        n = len(list(same))
        yield from [(letter, most)] * (n // most) + ([(letter, n % most)] if n % most else [])


def pack(seq: str, qual: str | None = None) -> bytes:
    """One record; letters other than A to Z are N, qualities shorter than the sequence are left out."""
    if not seq:
        return b""
    if len(seq) >= 1 << 23:
        raise ValueError("a sequence of over 8,388,607 bases")
    clean = "".join(c if "A" <= c <= "Z" else "N" for c in seq.upper())
    symbols = [(n - 1) << 5 | (ord(c) - 64) for c, n in _runs(clean, 4)]
    steps = [b ^ a for a, b in zip([0, *symbols], symbols, strict=False)]
    body = bytearray()
    for step, n in ((s, n) for s, same in groupby(steps) for n in [len(list(same))]):
        # Pairs of equal steps share a byte.
        body += bytes([step | 0x80]) * (n // 2) + bytes([step]) * (n % 2)
    has_quality = qual is not None and len(qual) >= len(seq)
    if has_quality:
        for letter, n in _runs(qual[: len(seq)], 256):
            value, more = ord(letter) & 0x7F, n - 1
            body += bytes([value]) if n == 1 else bytes([0x80 | more & 0x7F, value | more & 0x80])
    if len(body) >= 1 << 24:
        raise ValueError("a payload of over 16,777,215 bytes")
    return len(body).to_bytes(3, "big") + (has_quality << 23 | len(seq)).to_bytes(3, "big") + bytes(body)


def _bases(body: bytes, n: int) -> tuple[str, int]:
    out, at, size, symbol = [], 0, 0, 0
    while size < n:
        if at >= len(body):
            raise ValueError("truncated sequence")
        for _ in range(1 + (body[at] >> 7)):
            symbol ^= body[at] & 0x7F
            out.append(chr((symbol & 31) + 64) * ((symbol >> 5) + 1))
            size += (symbol >> 5) + 1
        at += 1
    return "".join(out)[:n], at


def _qualities(body: bytes, at: int, n: int) -> str:
    out, size = [], 0
    while size < n:
        if at + (at < len(body) and body[at] >> 7) >= len(body):
            raise ValueError("truncated qualities")
        run, value = (1, body[at]) if body[at] < 0x80 else ((body[at] & 0x7F | body[at + 1] & 0x80) + 1, body[at + 1] & 0x7F)
        out.append(chr(value) * run)
        size, at = size + run, at + 1 + (body[at] >> 7)
    return "".join(out)[:n]


def unpack(data: bytes, suffix: str = "") -> Iterator[tuple[str, str, str | None]]:
    """(header, seq, qual) of each record that isn't empty; names are read_1, read_2 and so on, with the suffix."""
    at, number = 0, 0
    while at < len(data):
        if at + HEADER > len(data):
            raise ValueError("truncated header")
        size, shape = int.from_bytes(data[at : at + 3], "big"), int.from_bytes(data[at + 3 : at + 6], "big")
        body, n = data[at + HEADER : at + HEADER + size], shape & (1 << 23) - 1
        if len(body) < size:
            raise ValueError("truncated record")
        at += HEADER + size
        if size and n:
            number += 1
            seq, end = _bases(body, n)
            yield f"read_{number}{suffix}", seq, _qualities(body, end, n) if shape >> 23 else None


def read_packed(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """file, ord, header, seq, qual; a task reads a file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, data in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame([(file, i, *r) for i, r in enumerate(unpack(data, suffix))], columns=["file", "ord", "header", "seq", "qual"])

    return files.mapInPandas(run, f"file string, ord bigint, {RECORD}")


def packed_records(df: DataFrame, seq: str, qual: str, order: list[str]) -> DataFrame:
    """record (binary): the rows' records in order; joined, they are a file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"record": [pack(s or "", q) for s, q in zip(part["seq"], part["qual"], strict=True)]})

    return df.orderBy(*order).select(F.col(seq).alias("seq"), F.col(qual).alias("qual")).mapInPandas(run, "record binary")
