"""Hard negatives: for each anchor and positive, the best rows of other labels below it.

Scoring runs in blocks: a bounded block of anchors is sent to all tasks, each task scores its
rows against it and keeps only what can still be an answer, so the number of rows that are
shuffled grows with anchors times tasks, not with pairs.  A first pass finds the positives,
which fix the windows; a second finds the negatives inside them.  Positives and negatives
then meet by a secondary sort: anchor, descending score and id are packed into one key,
partitions are sorted by it, and one pass opens a window at each positive and fills it with
the negatives that follow.  The pass holds open windows only, never an anchor's rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quasirisk.llm.store import Store, map_batches
from quasirisk.llm.text import crc32
from quasirisk.plans.ids import with_row_id

#: Bytes of anchor vectors in one block, and scores held at once.
BLOCK_BYTES, SCORES = 32 << 20, 1 << 21
#: Candidates a task gathers before it drops those that can no longer be answers.
HELD = 1 << 20
LONG_MAX = (1 << 63) - 1
#: Exact in a double, with room for the factor of the row's position.
SAFE = 1 << 48

MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_CANDIDATE = "anchor long, anchor_id long, score long, vec_id long, row long, positive boolean"
#: Anchor, inverted score, 0 for a positive, NULL id, id, row; big-endian, so bytes sort as the numbers do.
_KEY = struct.Struct(">QQB?QQ")


def prepared_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, label, q: rows that take part, with components as floor(scale * x).

    Rows with a NULL label or vector, or a NULL or non-finite component, are left out.
    """
    schema = "vec_id long, label long, q array<double>"

    def make():
        import numpy as np

        def each(batch):
            lists = batch.column(2)
            flat = lists.flatten()
            sizes = np.asarray(lists.value_lengths().fill_null(0))
            q = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(q * scale)
            bad = np.zeros(len(sizes), bool)
            bad[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(q)]] = True
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            whole = pa.ListArray.from_arrays(pa.array(ends), pa.array(q))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), whole], names=["vec_id", "label", "q"])
            yield out.filter(pa.array(~bad))

        return each

    known = vectors.filter("label IS NOT NULL AND embedding IS NOT NULL")
    known = known.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    return map_batches(known, schema, make).withColumn("row", F.monotonically_increasing_id())


def matrix(lists: pa.ListArray):
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    import numpy as np

    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def inner_products(a, b):
    """Exact integer products of all rows of ``a`` and ``b``; beyond a long, the long's bounds."""
    import numpy as np

    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if top < SAFE:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape)
    other = np.array([[int(x) for x in row] for row in b], object).reshape(b.shape)
    return np.clip(whole.dot(other.T) if width else np.zeros((len(a), len(b)), np.int64), -LONG_MAX, LONG_MAX).astype(np.int64)


class Candidates:
    """Columns anchor, score, vec_id, row of what a task has found, in blocks that are thinned."""

    def __init__(self, keep):
        self.keep, self.parts, self.held = keep, [], 0

    def add(self, anchor, score, vec_id, no_id, row) -> None:
        self.parts.append((anchor, score, vec_id, no_id, row))
        self.held += len(anchor)
        if self.held > HELD:
            self.thin()
            # What has to stay counts anew, so thinning does not start again at once.
            self.held = 0

    def thin(self) -> None:
        import numpy as np

        if not self.parts:
            return
        anchor, score, vec_id, no_id, row = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((row, vec_id, no_id, -score, anchor))
        anchor, score = anchor[order], score[order]
        kept = self.keep(anchor, score)
        order = order[kept]
        self.parts = [(anchor[kept], score[kept], vec_id[order], no_id[order], row[order])]

    def rows(self):
        self.thin()
        return self.parts[0] if self.parts else None


def position_in_run(keys, wanted=None):
    """For sorted keys: how many earlier rows of the same key are wanted."""
    import numpy as np

    flags = np.ones(len(keys), np.int64) if wanted is None else wanted.astype(np.int64)
    before = np.cumsum(flags) - flags
    head = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    return before - before[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]


def lowest(positive_score):
    """Least score n with 4 * p <= 5 * n, without leaving the range of a long."""
    return positive_score - positive_score // 5


def _scored(rows: DataFrame, sent, positives: int, negatives: int) -> DataFrame:
    """Candidates of all rows against one block of anchors; ``sent`` is a broadcast of (anchors, windows).

    Without ``windows``: the first ``positives`` rows of the anchor's label.  With ``windows``
    (positive scores by anchor, padded with the least long): the first ``negatives`` rows of
    other labels in each window.
    """

    def run(batches):
        import numpy as np

        block, windows = sent.value
        number, ids, labels, vectors = block["row"], block["vec_id"], block["label"], block["q"]

        def inside(anchor, score):
            if windows is None:
                return position_in_run(anchor) < positives
            kept = np.zeros(len(anchor), bool)
            for column in windows.T:
                high = column[anchor]
                fits = (score <= high) & (score >= lowest(high))
                kept |= fits & (position_in_run(anchor, fits) < negatives)
            return kept

        found = Candidates(inside)
        if windows is not None:
            open_ = windows > -LONG_MAX
            high = windows.max(axis=1)
            low = np.where(open_, lowest(windows), LONG_MAX).min(axis=1)
        for batch in batches:
            row, vec_id, label = (np.asarray(batch.column(i).fill_null(0)) for i in range(3))
            no_id = np.asarray(batch.column(1).is_null())
            q = matrix(batch.column(3))
            for value in np.unique(label):
                of = np.nonzero(label == value)[0]
                who = np.nonzero((labels == value) == (windows is None))[0]
                step = max(1, SCORES // max(1, len(of)))
                for at in range(0, len(who), step):
                    part = who[at : at + step]
                    score = inner_products(vectors[part], q[of])
                    if windows is None:
                        # The anchor's own row is no positive.
                        score[number[part][:, None] == row[of][None, :]] = -LONG_MAX - 1
                        if len(of) > positives:
                            edge = np.partition(score, -positives, axis=1)[:, -positives][:, None]
                        else:
                            edge = np.full((len(part), 1), -LONG_MAX)
                        hit = (score >= edge) & (score > -LONG_MAX - 1)
                    else:
                        hit = (score >= low[part][:, None]) & (score <= high[part][:, None])
                    a, r = np.nonzero(hit)
                    if len(a):
                        found.add(part[a], score[a, r], vec_id[of[r]], no_id[of[r]], row[of[r]])
        got = found.rows()
        if got is None:
            return
        anchor, score, vec_id, no_id, row = got
        for at in range(0, len(anchor), 100_000):
            cut = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[anchor[cut]]), pa.array(ids[anchor[cut]]), pa.array(score[cut]),
                 pa.array(vec_id[cut], mask=no_id[cut]), pa.array(row[cut]),
                 pa.array(np.full(len(anchor[cut]), windows is None))],
                names=["anchor", "anchor_id", "score", "vec_id", "row", "positive"],
            )

    return rows.select("row", "vec_id", "label", "q").mapInArrow(run, _CANDIDATE)


def pack_key(anchor: int, score: int, positive: bool, vec_id: int | None, row: int) -> bytes:
    """Key whose bytes sort by anchor, descending score, positives first, id (NULL last), row."""
    return _KEY.pack(anchor, LONG_MAX - score, not positive, vec_id is None, (vec_id or 0) + LONG_MAX + 1, row)


def unpack_key(key: bytes) -> tuple[int, int, bool, int | None]:
    anchor, score, negative, no_id, vec_id, _ = _KEY.unpack(key)
    return anchor, LONG_MAX - score, not negative, None if no_id else vec_id - LONG_MAX - 1


def fill_windows(sorted_rows: Iterable[tuple[bytes, int]], negatives: int) -> Iterator[tuple]:
    """One pass over (key, anchor id) in key order: negatives of each anchor and positive.

    A positive opens a window; each negative goes to all open windows it fits; a window
    closes when it is full or the scores have fallen below it.
    """
    current, windows = None, []
    for key, anchor_id in sorted_rows:
        anchor, score, positive, vec_id = unpack_key(key)
        if anchor != current:
            current, windows = anchor, []
        if positive:
            windows.append([vec_id, score, lowest(score), 0])
            continue
        windows = [w for w in windows if w[2] <= score and w[3] < negatives]
        for window in windows:
            if score <= window[1]:
                window[3] += 1
                yield anchor_id, window[0], window[3], vec_id, window[1], score


def hard_negatives(
    vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding, label.  Anchors are the rows whose vec_id is divisible
    by ``anchor_every``; positives are an anchor's first ``positives`` other rows of its label
    by descending score, then vec_id; negatives of a positive are the first ``negatives`` rows
    of other labels with 80 % to 100 % of its score.  Scores are inner products of the vectors
    floored at 1/256; a positive with a negative score has an empty window.

    Rows with a NULL label, vector or component, or a non-finite component, take no part.  A
    NULL vec_id is no anchor and sorts last.  Repeated rows are rows of their own: each is an
    anchor, and a positive or negative, by itself.  Vectors of different lengths are compared
    as if filled up with zeros.  Scores beyond a long are held at its bounds.  Other columns
    are ignored, an empty table gives no rows.
    """
    spark = vectors.sparkSession
    store = Store(spark, "negatives")
    rows = store.keep(prepared_rows(vectors), "rows")
    anchors = store.keep(with_row_id(store.keep(rows.filter(F.col("vec_id") % anchor_every == 0), "anchors"), "place"), "placed")
    shape = anchors.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    size = max(1, block_bytes // (8 * max(1, shape[1] or 0)))
    parts = []
    for at in range(0, shape[0], size):
        import numpy as np

        # At most ``block_bytes`` of vectors.
        got = anchors.filter(F.col("place").between(at, at + size - 1)).orderBy("place").select("row", "vec_id", "label", "q").toArrow()
        block = {c: np.asarray(got[c]) for c in ("row", "vec_id", "label")} | {"q": matrix(got["q"].combine_chunks())}
        sent = spark.sparkContext.broadcast((block, None))
        near = _scored(rows, sent, positives, negatives)
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
        near = near.withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= positives)
        near = store.keep(near, f"positives_{at}")
        sent.destroy()
        # At most ``positives`` rows for each anchor of the block.
        first = near.select("anchor", "n_", "score").toArrow()
        windows = np.full((len(block["row"]), positives), -LONG_MAX)
        by_row = np.argsort(block["row"])
        place = by_row[np.searchsorted(block["row"][by_row], np.asarray(first["anchor"]))]
        windows[place, np.asarray(first["n_"]) - 1] = np.asarray(first["score"])
        sent = spark.sparkContext.broadcast((block, windows))
        parts += [near.drop("n_"), store.keep(_scored(rows, sent, positives, negatives), f"negatives_{at}")]
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], MINED)
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = found.rdd.map(lambda r: (pack_key(r[0], r[2], r[5], r[3], r[4]), r[1]))
    by_anchor = keyed.repartitionAndSortWithinPartitions(tasks, lambda key: crc32(key[:8]))
    return spark.createDataFrame(by_anchor.mapPartitions(lambda it: fill_windows(it, negatives)), MINED, verifySchema=False)
