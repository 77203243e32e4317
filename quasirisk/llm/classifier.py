"""Text quality from random-indexing word vectors and a small network.

Every word has a fixed sparse random vector; its word vector is the sum of its neighbours'
random vectors over the whole corpus.  Words are hashed to a bounded number of rows, in lower
case, and so are their shapes (first and last characters), so what tasks and driver hold
does not grow.  Texts pool the vectors of their words by mean and deviation, and a network of
two layers, trained on a bounded sample of labelled rows, gives calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.llm.store import Store, map_batches, summed_parts
from quasirisk.llm.text import SOLID, columns, fold, make_hasher, slabs

#: Rows for words and for shapes, dimensions, and neighbours to either side.
WORD_ROWS, SHAPE_ROWS, DIMS, REACH = 6144, 2048, 48, 2
#: Labelled rows to train on at most, chosen by a hash of their ids.
TRAIN_ROWS = 20_000
SLAB = 1 << 20
#: Rows of a summed part of the vectors.
PART = 512


def make_rows():
    """Function from texts to the word rows, shape rows and first word of each text."""
    import numpy as np

    hashes = make_hasher(SOLID)
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 2

    def rows(texts: Sequence[str | None]):
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        raw = b"\n".join(raws)
        words, starts, ends = hashes(raw.lower())
        data = np.frombuffer(raw, np.uint8)
        shape = (kind[data[starts]] * 4 + kind[data[ends - 1]]) * 256 + data[ends - 1]
        shape = shape * 4 + np.minimum(3, (ends - starts) // 4)
        shapes = (shape.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)).astype(np.int64)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        return (words % np.uint64(WORD_ROWS)).astype(np.int64), WORD_ROWS + shapes % SHAPE_ROWS, bounds

    return rows


def word_vectors(docs: DataFrame, seed: int = 3):
    """Unit word vectors over all texts, as an array of fixed size.

    Each task adds up its own; parts of rows are summed across tasks, and the driver gets
    one array of (WORD_ROWS + SHAPE_ROWS) x DIMS.
    """
    import numpy as np

    total = WORD_ROWS + SHAPE_ROWS
    rng = np.random.default_rng(seed)
    where = np.stack([rng.permutation(DIMS)[:2] for _ in range(total)])
    sign = rng.choice([-1.0, 1.0], (total, 2))

    def sums(batches):
        rows = make_rows()
        vectors = np.zeros(total * DIMS)
        for batch in batches:
            texts = columns(batch, "text")[0]
            for a, b in slabs(texts, SLAB):
                words, shapes, bounds = rows(texts[a:b])
                doc = np.repeat(np.arange(b - a), np.diff(bounds))
                for ids in (words, shapes):
                    for step in range(1, REACH + 1):
                        near = np.nonzero(doc[step:] == doc[:-step])[0] if len(doc) > step else np.zeros(0, np.int64)
                        for x, y in ((ids[near], ids[near + step]), (ids[near + step], ids[near])):
                            for k in range(2):
                                vectors += np.bincount(x * DIMS + where[y, k], sign[y, k], total * DIMS)
        parts = vectors.astype(np.float32).reshape(-1, PART * DIMS)
        values = pa.ListArray.from_arrays(np.arange(0, parts.size + 1, PART * DIMS, dtype=np.int32), pa.array(parts.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), values], names=["part", "values"])

    vectors = np.zeros((total // PART, PART * DIMS), np.float32)
    # Of a size fixed by the constants above.
    for part, values in summed_parts(docs.select("text").mapInArrow(sums, "part int, values array<float>")).items():
        vectors[part] = values
    vectors = vectors.reshape(total, DIMS)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def make_pool(vectors):
    """Function from texts to one row of features each; all zero for texts without words."""
    import numpy as np

    rows = make_rows()

    def pool(texts):
        out = np.zeros((len(texts), 4 * DIMS + 1), np.float32)
        for a, b in slabs(texts, SLAB):
            words, shapes, bounds = rows(texts[a:b])
            sizes = np.diff(bounds)
            full = np.nonzero(sizes)[0]
            if not len(full):
                continue
            n = sizes[full, None].astype(np.float32)
            for k, ids in enumerate((words, shapes)):
                held = vectors[ids]
                mean = np.add.reduceat(held, bounds[full], axis=0) / n
                np.square(held, out=held)
                square = np.add.reduceat(held, bounds[full], axis=0) / n
                out[a + full, 2 * k * DIMS : (2 * k + 1) * DIMS] = mean
                out[a + full, (2 * k + 1) * DIMS : (2 * k + 2) * DIMS] = np.sqrt(np.maximum(square - mean * mean, 0))
            out[a + full, -1] = np.log1p(sizes[full])
        return out

    return pool


class Network:
    """Two layers; ``fit`` trains them and the temperature, ``score`` gives probabilities."""

    def __init__(self, hidden: int = 32, epochs: int = 30, seed: int = 5):
        self.hidden, self.epochs, self.seed = hidden, epochs, seed

    def fit(self, x, y):
        import numpy as np

        rng = np.random.default_rng(self.seed)
        self.constant = float(y.mean()) if len(y) else 0.5
        if len(y) < 20 or y.min() == y.max():
            self.weights = None  # nothing to tell apart: the share of good labels for all
            return self
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-4
        x = (x - self.centre) / self.scale
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 10], order[len(y) // 10 :]
        shape = (x.shape[1], self.hidden)
        w = [rng.normal(0, shape[0] ** -0.5, shape), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(())]
        first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for _ in range(self.epochs):
            mixed = rng.permutation(used)
            for at in range(0, len(mixed), 256):
                xb, yb = x[mixed[at : at + 256]], y[mixed[at : at + 256]]
                h = np.maximum(xb @ w[0] + w[1], 0)
                delta = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - yb) / len(yb)
                back = np.outer(delta, w[2]) * (h > 0)
                grads = [xb.T @ back + 1e-4 * w[0], back.sum(0), h.T @ delta + 1e-4 * w[2], delta.sum()]
                step += 1
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] = w[i] - 2e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        logits, truth = self._logits(x[held]), y[held]
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
        if len(held):
            self.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss)
        return self

    def _logits(self, x):
        import numpy as np

        w = self.weights
        return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]

    def score(self, x):
        import numpy as np

        if self.weights is None:
            return np.full(len(x), self.constant)
        logits = self._logits((x - self.centre) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, folds: int, rows: int) -> DataFrame:
    """text and quality of at most ``rows`` labelled documents outside the held-out fold.

    Ids with NULL or with labels that disagree are left out.  Only this bounded list of ids
    is broadcast.
    """
    agreed = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    agreed = agreed.agg(F.min("quality").alias("quality"), F.max("quality").alias("high")).filter("quality = high")
    agreed = agreed.filter(fold(F.col("doc_id"), folds) != 0).select("doc_id", "quality")
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality")


def quality_scores(
    docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``.

    ``held_out`` rows, whose crc32(doc_id as text) is a multiple of ``folds``, teach no
    label.  The network sees at most ``train_rows`` labelled texts, the vectors all texts.
    NULL is an empty text.  Without labels of both kinds the score is the share of good ones.
    """
    import numpy as np

    spark = docs.sparkSession
    Store(spark, "classifier")
    vectors = word_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def make_features():
        pool = make_pool(shared.value)

        def each(batch):
            texts, quality = columns(batch, "text", "quality")
            x = pool(texts)
            values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([values, pa.array(quality).cast(pa.int32())], names=["x", "quality"])

        return each

    sample = training_sample(docs, labels, folds, train_rows)
    taught = map_batches(sample, "x array<float>, quality int", make_features).toArrow()
    # The order of rows must not depend on the tasks that deliver them.
    x = taught.column("x").combine_chunks().flatten().to_numpy().reshape(-1, 4 * DIMS + 1).astype(np.float64)
    y = taught.column("quality").to_numpy().astype(np.float64)
    order = np.lexsort((*x[:, :8].T, y)) if len(y) else []
    network = spark.sparkContext.broadcast(Network().fit(x[order], y[order]))

    def make_scores():
        pool, net = make_pool(shared.value), network.value

        def each(batch):
            ids, texts = columns(batch, "doc_id", "text")
            scores = net.score(pool(texts).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores)], names=["doc_id", "score"])

        return each

    scored = map_batches(docs.select("doc_id", "text"), "doc_id long, score double", make_scores)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
