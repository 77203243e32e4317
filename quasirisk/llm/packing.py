"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made over the histogram of piece lengths, whose size is bounded by the
capacity, never over documents.  Pieces take their planned slots by joining on their rank
among the pieces of equal length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quasirisk.llm.store import Store, map_batches
from quasirisk.llm.text import columns, crc32

#: Chunks between white space, and letter runs, that a worker remembers the ids of.
CACHE_CHUNKS, CACHE_RUNS = 1_000_000, 500_000
#: Texts that are looked up together.
GROUP = 128

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Letters, then marks: the vocabulary's own splitting cuts between the two in any case.
_LETTERS_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:*#$%&|]*)")


def make_encoder(tokenizer_path: str):
    """Function from texts to their ids, each text's as little-endian unsigned 32-bit bytes.

    The vocabulary never looks across white space, nor from a run of letters to the marks
    behind it, so ids are put together from those parts; each part is tokenised once per
    worker as long as the caches have room.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import numpy as np
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    chunks: dict[bytes, bytes] = {}
    runs: dict[str, bytes] = {}

    def tokenise(parts: list[str]) -> None:
        # A run of ASCII letters is one piece for the merges, so they can start at once.
        for part in [p for p in parts if p.isascii() and p.isalpha()]:
            runs[part] = np.asarray([t.id for t in tokenizer.model.tokenize(part)], "<u4").tobytes()
        parts = [p for p in parts if p not in runs]
        for part, one in zip(parts, tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            runs[part] = np.asarray(one.ids, "<u4").tobytes()

    def learn(missing: list[bytes]) -> None:
        if len(chunks) + len(missing) > CACHE_CHUNKS:
            chunks.clear()
        if len(runs) > CACHE_RUNS:
            runs.clear()
        split = []
        for raw in missing:
            text = raw.decode("utf-8")
            cut = _LETTERS_MARKS.fullmatch(text)
            split.append((cut[1].lower(), cut[2]) if cut else (text, ""))
        tokenise([p for p in dict.fromkeys(p for pair in split for p in pair) if p not in runs])
        for raw, (head, tail) in zip(missing, split, strict=True):
            chunks[raw] = runs[head] + runs[tail]

    def of_texts(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), GROUP):
            group, missing = [], set()
            for text in texts[at : at + GROUP]:
                words = text.encode("utf-8", "replace").split()
                ids = list(map(chunks.get, words))
                gaps = []
                if None in ids:
                    i = -1
                    for _ in range(ids.count(None)):
                        i = ids.index(None, i + 1)
                        gaps.append(i)
                        missing.add(words[i])
                group.append((words, ids, gaps))
            if missing:
                learn(list(missing))
            for words, ids, gaps in group:
                for i in gaps:
                    ids[i] = chunks[words[i]]
                out.append(b"".join(ids))
        return out

    return of_texts


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise each text, append ``end_id`` and cut what is longer than ``capacity``.

    NULL and empty texts give one piece that holds the end only.  ``ids_crc32`` is the
    checksum of the ids as little-endian unsigned 32-bit numbers.
    """

    def make():
        encode, end = make_encoder(tokenizer_path), end_id.to_bytes(4, "little")

        def each(batch):
            rows = []
            doc_ids, texts = columns(batch, "doc_id", "text")
            for doc_id, ids in zip(doc_ids, encode([t or "" for t in texts]), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, crc32(part)))
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        return each

    return map_batches(docs.select("doc_id", "text"), PIECES, make)


@dataclass(frozen=True)
class Run:
    """Ranks [lo, hi) of one length fill ``per`` slots each in sequences from ``first`` on."""

    length: int
    lo: int
    hi: int
    per: int
    first: int
    offset: int


def best_fit(histogram: Iterable[tuple[int, int]], capacity: int) -> tuple[list[Run], int]:
    """Best fit by decreasing length over (length, count), in groups of equal sequences.

    Returns the runs and the number of sequences.  Placing a length opens at most two new
    groups and splits at most two, so runs depend on the capacity, not on the counts.
    """
    open_groups: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, how many)
    runs: list[Run] = []
    sequences = 0
    for length, count in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("lengths must be from 1 to the capacity")
        rank = 0

        def place(first: int, many: int, room: int, per: int, length: int = length) -> None:
            nonlocal rank
            runs.append(Run(length, rank, rank + many * per, per, first, capacity - room))
            rank += many * per
            if room - per * length:
                open_groups.setdefault(room - per * length, []).append((first, many))

        while rank < count:
            room = min((r for r in open_groups if r >= length), default=None)
            if room is None:
                # New sequences: as many full ones as the count gives, then a partial one.
                per, left = capacity // length, count - rank
                first, many = sequences, -(-left // per)
                sequences += many
                room = capacity
            else:
                first, many = open_groups[room].pop()
                if not open_groups[room]:
                    del open_groups[room]
                per = room // length
            full = min(many, (count - rank) // per)
            if full:
                place(first, full, room, per)
            rest = (count - rank) if full < many else 0
            if rest:
                place(first + full, 1, room, rest)
            untouched = many - full - (1 if rest else 0)
            if untouched:
                open_groups.setdefault(room, []).append((first + many - untouched, untouched))
    return runs, sequences


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and a gapless ``offset`` to rows with ``piece_id`` columns and ``length``.

    Expects a stored table: it is read twice.  Ranks are counted per (length, bucket) and
    the buckets' counts summed up, so a length that a third of all rows share is spread.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = max(1, math.isqrt(total) // 8)
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    placed = pieces.withColumn("bucket_", spread)
    counts = placed.groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n_"))
    # At most one row per length up to the capacity.
    runs, _ = best_fit([(r["length"], r["n_"]) for r in histogram.collect()], capacity)
    rows = [(r.length, r.lo, r.hi, r.per, r.first, r.offset) for r in runs]
    plan = spark.createDataFrame(rows, "length long, lo_ long, hi_ long, per_ long, first_ long, at_ long")
    before = Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    inside = Window.partitionBy("length", "bucket_").orderBy("doc_id", "piece", "ids_crc32")
    ranked = placed.withColumn("row_", F.row_number().over(inside) - 1).join(bases, ["length", "bucket_"])
    ranked = ranked.withColumn("rank_", F.col("row_") + F.col("base_"))
    # The plan's size is bounded by the capacity.
    joined = ranked.alias("r").join(
        F.broadcast(plan.alias("p")),
        (F.col("r.length") == F.col("p.length")) & (F.col("rank_") >= F.col("lo_")) & (F.col("rank_") < F.col("hi_")),
    )
    step = F.col("rank_") - F.col("lo_")
    return joined.select(
        *[F.col(f"r.{c}") for c in pieces.columns],
        (F.col("first_") + F.floor(step / F.col("per_"))).cast("long").alias("sequence_id"),
        (F.col("at_") + step % F.col("per_") * F.col("r.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Only
    texts longer than the capacity are cut.  Rows with equal or NULL ids are packed like
    any other; other columns are ignored; an empty table gives no rows.
    """
    store = Store(docs.sparkSession, "packing")
    pieces = store.keep(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity)
