"""Near duplicates by SimHash, linked through BK-trees.

Fingerprints that differ in at most r of 64 bits agree on at least m - r of m blocks of
bits, so every pair to link meets in a shard named by the values of some m - r blocks.  Each
shard's distinct fingerprints are put into BK-trees (children keyed by their Hamming
distance to the parent), and a query follows only the edges whose distance to the parent
is within r of its own.  A shard with many fingerprints is dealt out as pairs of chunks: each
chunk's tree goes to every chunk of queries.  Tasks return a spanning forest, never pairs.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quasirisk.llm.components import connected_components
from quasirisk.llm.store import Store, map_batches
from quasirisk.llm.text import byte_words, columns

BITS = 64
#: Fingerprints in one tree, and queries sent to it at once.
CHUNK = 4096
#: Expected fingerprints in a shard, from which the number of blocks follows.
SHARD_ROWS = 64


def make_simhash(shingle: int):
    """Function from a text to its fingerprint as an unsigned integer."""
    import numpy as np
    import xxhash

    def simhash(text: str | None) -> int:
        words = byte_words(text, lower=True)
        if not words:
            return 0
        hash_ = xxhash.xxh64_intdigest
        if len(words) <= shingle:
            return hash_(b" ".join(words), 42)
        n = len(words) - shingle + 1
        raw = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        hashes = [hash_(raw[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        counts = np.zeros(BITS, np.int64)
        for at in range(0, n, 1 << 16):
            block = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
        set_ = np.packbits(2 * counts > n, bitorder="little")
        return int(set_.view("<u8")[0])

    return simhash


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``docs`` without its text, with fp: a signed long that has the fingerprint's bits."""
    rest = docs.drop("text").schema
    schema = T.StructType([*rest.fields, T.StructField("fp", T.LongType())])

    def make():
        simhash = make_simhash(shingle)

        def each(batch):
            fps = [simhash(t) for t in columns(batch, "text")[0]]
            arrays = [batch.column(batch.schema.get_field_index(f)) for f in rest.names]
            fps = pa.array([_signed(f) for f in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays, fps], names=[*rest.names, "fp"])

        return each

    return map_batches(docs, schema, make)


class BKTree:
    """Integers by Hamming distance.  ``find`` yields the stored values within ``radius``."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            if distance == 0:
                return
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (value, {})
                return
            node = child

    def find(self, value: int, radius: int):
        stack = [self.root] if self.root else []
        while stack:
            node, children = stack.pop()
            distance = (node ^ value).bit_count()
            if distance <= radius:
                yield node
            if len(children) <= 2 * radius:
                for edge, child in children.items():
                    if -radius <= edge - distance <= radius:
                        stack.append(child)
            else:
                for edge in range(max(1, distance - radius), distance + radius + 1):
                    if edge in children:
                        stack.append(children[edge])


def block_masks(distinct: int, radius: int) -> tuple[list[int], int]:
    """Masks of the block sets whose agreement covers all pairs within ``radius``, and m.

    m grows with the number of fingerprints so that random ones leave a shard small; any m
    above the radius finds every pair.
    """
    m = radius + 1
    while m < radius + 6 and distinct / 2 ** ((m - radius) * (BITS // m)) > SHARD_ROWS:
        m += 1
    cuts = [round(i * BITS / m) for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, m - radius)], m


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_links(distinct: DataFrame, radius: int, store: Store) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all within ``radius``."""
    masks, _ = block_masks(distinct.count(), radius)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("set", "mask"))
    keyed = keyed.select("fp", "set", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    sizes = keyed.groupBy("set", "value").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # Most shards hold one fingerprint and end here.
    met = keyed.join(sizes, ["set", "value"])
    chunks = F.ceil(F.col("rows") / CHUNK).cast("int")
    met = met.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # A fingerprint of chunk c is in the tree of (c, j) for j >= c, and a query of (i, c), i < c.
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("fp", "set", "value", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("queries"),
                     (F.col("own") <= F.col("other")).alias("in_tree"))
    # Small shards are worked off many at a time; rows of one (shard, chunk pair) stay together.
    keys = ["set", "value", "tree", "queries"]
    sorted_ = met.repartition(*keys).sortWithinPartitions(*keys)

    def make():
        state: dict = {"key": None, "tree": [], "queries": []}

        def links(key, tree_fps, query_fps):
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            tree = BKTree()
            found = []

            def link(x: int, y: int) -> None:
                p, q = root(x), root(y)
                if p != q:
                    parent[p] = q
                    found.append((x, y))

            if key[2] == key[3]:
                for fp in tree_fps:
                    for near in tree.find(fp & (2**64 - 1), radius):
                        link(fp, _signed(near))
                    tree.add(fp & (2**64 - 1))
            else:
                for fp in tree_fps:
                    tree.add(fp & (2**64 - 1))
                for fp in query_fps:
                    for near in tree.find(fp & (2**64 - 1), radius):
                        link(fp, _signed(near))
            return found

        def flush():
            found = links(state["key"], state["tree"], state["queries"]) if state["key"] else []
            state["tree"], state["queries"] = [], []
            return found

        def each(batches):
            for batch in batches:
                out = []
                for fp, *key, in_tree in zip(*columns(batch, "fp", *keys, "in_tree"), strict=True):
                    if key != state["key"]:
                        out += flush()
                        state["key"] = key
                    state["tree" if in_tree else "queries"].append(fp)
                yield edges(out)
            yield edges(flush())

        def edges(out):
            a, b = ([x[i] for x in out] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return each

    return sorted_.mapInArrow(lambda batches: make()(batches), "a long, b long")


def _linked(own: DataFrame, radius: int, store: Store) -> DataFrame:
    """fp, root (a fingerprint that names the component) and component_id."""
    distinct = store.keep(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(shard_links(distinct.select("fp"), radius, store), store)
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return store.keep(named.join(names, "root").select("fp", "root", "component_id"), "names")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of ``docs``.

    Texts whose fingerprints differ in at most ``radius`` bits are linked; component_id is
    the smallest doc_id reachable, NULL only if all are.  NULL and empty texts have
    fingerprint zero and are linked like any other; rows with equal ids keep their own
    fingerprints.
    """
    store = Store(docs.sparkSession, "simhash")
    own = store.keep(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "fingerprints")
    found = own.join(_linked(own, radius, store).drop("root"), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, the one with its smallest doc_id, with all its columns.

    A NULL id comes after all others.  Of rows with equal id and fingerprint one stays.
    """
    store = Store(docs.sparkSession, "dedup")
    whole = store.keep(fingerprints(docs.select("doc_id", "text", F.struct("*").alias("doc")), shingle), "documents")
    own = whole.select("doc_id", "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")).alias("first")
    keepers = own.join(_linked(own, radius, store), "fp").groupBy("root").agg(first).select("first.doc_id", "first.fp")
    keepers = keepers.select(F.col("doc_id").alias("keep_id"), F.col("fp").alias("keep_fp"))
    kept = whole.join(keepers, (F.col("fp") == F.col("keep_fp")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    row = Window.partitionBy("keep_fp", "keep_id").orderBy(F.xxhash64("doc"))
    return kept.withColumn("row_", F.row_number().over(row)).filter("row_ = 1").select("doc.*")
