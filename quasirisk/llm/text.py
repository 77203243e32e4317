"""Words, lines and digests of texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, as a Java and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8; bytes.split() and bytes.lower() know ASCII only, as wanted."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    return (raw.lower() if lower else raw).split()


def words_column(text: Column) -> Column:
    """Array of words; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a NULL id counts as the text "null"."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % modulus


def spans_text(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def spans_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw) & 0xFFFFFFFF


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


#: Bytes of words: all but white space.
SOLID = tuple(b for b in range(256) if b != 32 and not 9 <= b <= 13)


#: Longer words are hashed one by one: sums of powers of an odd base repeat on patterns of such length.
LONG_WORD = 64


def make_hasher(of_words: Iterable[int]):
    """Function from UTF-8 bytes to the 64-bit hashes, starts and ends of their words.

    A word is a run of the bytes ``of_words``.  Each byte stands for a random number, so that
    none adds nothing; hashes are differences of polynomial prefix sums, mixed with the length,
    so no word of usual length becomes a Python object.
    """
    import numpy as np
    import xxhash

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    inside = np.zeros(256, bool)
    inside[list(of_words)] = True
    stands_for = np.random.default_rng(20).integers(1, (1 << 64) - 1, 256, np.uint64, endpoint=True)
    powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

    def table(which: str, factor: int, n: int):
        if len(powers[which]) < n:
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            powers[which] = np.cumprod(steps)
        return powers[which]

    def hashes(raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        edge = np.diff(inside[data].astype(np.int8), prepend=0, append=0)
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(stands_for[data] * table("up", base, n + 1)[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * table("down", inverse, n + 1)[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        for i in np.nonzero(ends - starts > LONG_WORD)[0].tolist():
            h[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], 77)
        return h, starts, ends

    return hashes


def slabs(texts: Sequence[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts of about ``size`` characters together."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text or "") > size:
            yield begin, i
            begin, held = i, 0
        held += len(text or "")
    if begin < len(texts):
        yield begin, len(texts)
