"""Benchmark passages in documents, also edited ones.

Texts and items are sequences of words in lower case without punctuation.  The CGK random
walk reads a window word by word and at each step stays or moves on by a random bit that
depends on step and word; windows at edit distance e end up at Hamming distance O(e^2), most
often O(e), of equal outputs in between.  A key samples outputs at a few steps, and
repetitions with fresh bits are added until simulated edits of the items reach the target
recall in each class.  Windows have the size class of an item, at every word of the items
and every few words of the texts.  Items too short for that, and classes that miss the
target, are found by equal parts instead.  Candidates are verified by the exact edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.llm.store import Store, map_batches
from quasirisk.llm.text import columns, make_hasher

#: Bytes of text that are worked on at once, and of items in one index.
SLAB, BLOCK = 1 << 20, 8 << 20
#: Words of window classes; a walk takes two steps a word.
CLASSES = (2, 4, 8, 16, 32)
EXACT = 0
SAMPLES = 6
STRIDE = 4
#: Repetitions at most, and simulated copies for each class.
MAX_REPEATS, COPIES = 12, 200
#: Bytes of words: ASCII letters and digits, and all of other characters.
PLAIN = (*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256))


def _numpy():
    import numpy as np

    return np


class Index:
    """Keys of item windows by class and repetition, and exact parts of items outside the classes.

    Items too short for a window at each stride, and items of classes whose keys miss the
    wanted recall, are cut into one part more than edits are allowed: one part is intact in
    every copy, so looking for equal parts at every word finds all.
    """

    def __init__(self, items: Sequence, max_edits: float, seed: int = 7):
        np = _numpy()
        self.items, self.max_edits = items, max_edits
        rng = np.random.default_rng(seed)
        steps = 2 * CLASSES[-1]
        self.factors = rng.integers(1, 1 << 63, (MAX_REPEATS, steps), np.uint64) * np.uint64(2) + np.uint64(1)
        self.mix = rng.integers(1, 1 << 63, (MAX_REPEATS, steps), np.uint64) * np.uint64(2) + np.uint64(1)
        self.samples = [
            {c: np.sort(rng.permutation(2 * c)[: min(SAMPLES, 2 * c)]).tolist() for c in CLASSES} for _ in range(MAX_REPEATS)
        ]
        self.classes = [self.class_of(len(w)) for w in items]
        self.used = sorted(set(self.classes) - {EXACT})
        self.tables: list[dict] = []
        self.parts: dict[int, tuple] = {}
        #: Share of simulated copies that the keys of each class find; 1 where the search is exact.
        self.recall: dict[int, float] = {EXACT: 1.0}

    def add_repeat(self) -> None:
        self.tables.append({c: self._table(len(self.tables), c) for c in self.used})

    @staticmethod
    def class_of(words: int) -> int:
        """The largest class of which a window at each stride fits into the item; EXACT if none does."""
        return max((c for c in CLASSES if 5 * c <= 4 * (words - STRIDE + 1)), default=EXACT)

    def settle(self, recall: float) -> None:
        """Make classes below ``recall`` exact and the tables of all exact items."""
        np = _numpy()
        weak = {c for c in self.used if self.recall.get(c, 0.0) < recall}
        self.classes = [EXACT if c in weak else c for c in self.classes]
        self.used = [c for c in self.used if c not in weak]
        self.recall = {c: r for c, r in self.recall.items() if c not in weak}
        for table in self.tables:
            for c in weak:
                table.pop(c, None)
        found: dict[int, list] = {}
        for i, words in enumerate(self.items):
            if self.classes[i] != EXACT:
                continue
            n = int(self.max_edits * len(words)) + 1
            edges = [len(words) * k // n for k in range(n + 1)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                found.setdefault(hi - lo, []).append((int(self.sequences(words[lo:hi], hi - lo)[0]), i, lo))
        for size, rows in found.items():
            rows.sort()
            keys, owners, offsets = (np.array(x, t) for x, t in zip(zip(*rows, strict=True), (np.uint64, np.int64, np.int64), strict=True))
            hit = np.zeros(1 << 20, bool)
            hit[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.parts[size] = (keys, owners, offsets, hit)

    def sequences(self, words, size: int):
        """Hashes of all ``size`` neighbouring words."""
        np = _numpy()
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[j : j + n]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0x9FB21C651E98DF25)

    def keys(self, words, starts, repeat: int):
        """Class and key of the walks of one repetition from ``starts``; words are padded."""
        np = _numpy()
        at = starts.astype(np.int64)
        seen = np.empty(len(at), np.uint64)
        bit = np.empty(len(at), np.uint64)
        sums = {c: np.zeros(len(at), np.uint64) for c in self.used}
        for step in range(2 * self.used[-1]):
            np.take(words, at, out=seen, mode="clip")
            for c in self.used:
                if step in self.samples[repeat][c]:
                    sums[c] += (seen ^ (seen >> np.uint64(31))) * self.mix[repeat, step]
            np.multiply(seen, self.factors[repeat, step], out=bit)
            np.right_shift(bit, np.uint64(63), out=bit)
            at += bit.view(np.int64)
        return sums, at

    def _table(self, repeat: int, c: int):
        np = _numpy()
        keys, owners, offsets = [], [], []
        for i, words in enumerate(self.items):
            if self.classes[i] != c:
                continue
            # Beyond the item comes what no text has; such walks find nothing and do no harm.
            padded = np.concatenate((words, np.arange(1, 2 * CLASSES[-1] + 2, dtype=np.uint64) * np.uint64(i + 1)))
            starts = np.arange(max(1, len(words) - c + 1))
            keys.append(self.keys(padded, starts, repeat)[0][c])
            owners.append(np.full(len(starts), i))
            offsets.append(starts)
        keys, owners, offsets = map(np.concatenate, (keys, owners, offsets))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        # A bitmap of the upper bits of the keys lets most windows end after one look.
        hit = np.zeros(1 << 20, bool)
        hit[(keys >> np.uint64(44)).astype(np.int64)] = True
        return keys, owners[order], offsets[order], hit

    def candidates(self, words, first: int = 0):
        """Set of (start of the item in words, item) that some key or part suggests, from repetition ``first``."""
        np = _numpy()
        found: set[tuple[int, int]] = set()

        def look_up(wanted, starts, table):
            keys, owners, offsets, hit = table
            near = np.nonzero(hit[(wanted >> np.uint64(44)).astype(np.int64)])[0]
            lo, hi = np.searchsorted(keys, wanted[near], "left"), np.searchsorted(keys, wanted[near], "right")
            met = hi > lo
            sizes = (hi - lo)[met]
            entry = np.arange(int(sizes.sum())) + np.repeat(lo[met] - (np.cumsum(sizes) - sizes), sizes)
            at = np.repeat(starts[near[met]], sizes) - offsets[entry]
            found.update(zip(at.tolist(), owners[entry].tolist(), strict=True))

        if self.used:
            padded = np.concatenate((words, np.arange(1, 2 * CLASSES[-1] + 2, dtype=np.uint64)))
            starts = np.arange(0, len(words), STRIDE)
            for repeat, tables in enumerate(self.tables[first:], first):
                sums, _ = self.keys(padded, starts, repeat)
                for c, table in tables.items():
                    look_up(sums[c], starts, table)
        for size, table in self.parts.items():
            wanted = self.sequences(words, size)
            look_up(wanted, np.arange(len(wanted)), table)
        return found


def edit_distance_within(item: Sequence[int], text: Sequence[int], limit: int) -> int | None:
    """Smallest edit distance of ``item`` to any part of ``text``, if at most ``limit``.

    Bit-parallel columns over one integer of as many bits as the item has words.
    """
    m = len(item)
    where: dict[int, int] = {}
    for i, word in enumerate(item):
        where[word] = where.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for word in text:
        eq = where.get(word, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = (minus | ~(d | plus)) & full, plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = (down | ~(x | up)) & full, up & x
        best = min(best, score)
    return best if best <= limit else None


def word_groups(texts: Sequence[str | None], hashes, overlap: int):
    """(rows, words, first word of each part) of neighbouring texts of about SLAB bytes together.

    Longer texts are hashed between separators and come in parts that share ``overlap`` words.
    """
    np = _numpy()
    plain = bytes(PLAIN)
    between = re.compile(b"[^" + re.escape(plain) + b"]")
    step = max(SLAB // 8, 4 * overlap)

    def joined(group):
        words, starts, _ = hashes(b"\n".join(raw for _, raw in group))
        bounds = np.cumsum([0, *(len(raw) + 1 for _, raw in group)])
        return [row for row, _ in group], words, np.searchsorted(starts, bounds)

    group, held = [], 0
    for row, text in enumerate(texts):
        raw = (text or "").lower().encode("utf-8", "replace")
        if group and held + len(raw) > SLAB:
            yield joined(group)
            group, held = [], 0
        if len(raw) <= SLAB:
            group.append((row, raw))
            held += len(raw)
            continue
        begin, found = 0, []
        while begin < len(raw):
            cut = between.search(raw, begin + SLAB) if begin + SLAB < len(raw) else None
            end = cut.start() if cut else len(raw)
            found.append(hashes(raw[begin:end])[0])
            begin = end
        words = np.concatenate(found)
        for at in range(0, max(1, len(words) - overlap), step):
            part = words[at : at + step + overlap]
            yield [row], part, np.array([0, len(part)])
    if group:
        yield joined(group)


def make_finder(index: Index):
    """Function from texts to (row, item, edits), the fewest edits for each row and item."""
    np = _numpy()
    hashes = make_hasher(PLAIN)
    lists = [w.tolist() for w in index.items]
    overlap = 2 * max(map(len, lists)) + 4 * STRIDE

    def leaks(texts):
        found: dict[tuple[int, int], int] = {}
        for rows, words, first_word in word_groups(texts, hashes, overlap):
            if not len(words):
                continue
            for at, item in index.candidates(words):
                size = len(lists[item])
                # The middle of the passage tells which text it is in.
                part = int(np.searchsorted(first_word, min(max(at + size // 2, 0), len(words) - 1), "right")) - 1
                row = rows[part]
                limit = int(index.max_edits * size)
                if found.get((row, item)) == 0:
                    continue
                lo, hi = int(first_word[part]), int(first_word[part + 1])
                region = words[max(lo, at - limit - STRIDE) : min(hi, at + size + limit + STRIDE)].tolist()
                edits = edit_distance_within(lists[item], region, limit)
                if edits is not None:
                    found[row, item] = min(edits, found.get((row, item), edits))
        return [(row, item, edits) for (row, item), edits in found.items()]

    return leaks


def build_index(texts: Sequence[str], max_edits: float, recall: float) -> Index | None:
    """Index over items with at least one word; every class finds ``recall`` of its edited copies.

    For each class COPIES copies of its items get as many random word edits as are allowed, and
    repetitions are added until the wanted share of each class is found.  A class that misses
    it after MAX_REPEATS is searched exactly.  ``recall`` of the result holds the shares.
    """
    np = _numpy()
    hashes = make_hasher(PLAIN)
    items = [hashes(t.lower().encode("utf-8", "replace"))[0] for t in texts]
    if not items:
        return None
    rng = np.random.default_rng(11)
    filler = lambda n: rng.integers(1, 1 << 63, n, np.uint64)
    index = Index(items, max_edits)
    copies = []
    for c in index.used:
        for i in rng.choice([i for i, k in enumerate(index.classes) if k == c], COPIES).tolist():
            words = items[i].tolist()
            for _ in range(int(max_edits * len(words))):
                at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
                words[at : at + (kind != 1)] = [] if kind == 2 else [int(filler(1)[0])]
            copies.append((i, np.concatenate((filler(int(rng.integers(0, STRIDE))), np.array(words, np.uint64), filler(80)))))
    hits: set[int] = set()
    while copies and len(index.tables) < MAX_REPEATS and min(index.recall.get(c, 0.0) for c in index.used) < recall:
        index.add_repeat()
        everything = np.concatenate([words for _, words in copies])
        ends = np.cumsum([len(words) for _, words in copies])
        for at, i in index.candidates(everything, len(index.tables) - 1):
            k = int(np.searchsorted(ends, at + len(items[i]) // 2, "right"))
            if k < len(copies) and copies[k][0] == i:
                hits.add(k)
        for n, c in enumerate(index.used):
            index.recall[c] = sum(k in hits for k in range(n * COPIES, (n + 1) * COPIES)) / COPIES
    index.settle(recall)
    return index


def _blocks(benchmark: DataFrame) -> list[list]:
    """Rows of (item_id, text) in blocks of about BLOCK bytes; one block for most benchmarks."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK)
    rows = benchmark.filter(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).select("item_id", "text")
    spread = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    return [rows.filter(spread == i).collect() for i in range(n)]


def _finders(docs: DataFrame, benchmark: DataFrame, max_edits: float, recall: float):
    """For each block of items: their ids and a broadcast index."""
    for rows in _blocks(benchmark):
        index = build_index([r["text"] for r in rows], max_edits, recall)
        if index is not None:
            yield docs.sparkSession.sparkContext.broadcast((index, [r["item_id"] for r in rows]))


LEAKS = "doc_id long, item_id long, edits int, item_words int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.95) -> DataFrame:
    """(doc_id, item_id, edits, item_words) for each document and item found in it.

    Found is a part of the text whose word edit distance to the item is at most
    ``max_edits`` of the item's words.  Larger benchmarks go over the documents in blocks.
    NULL and empty texts, and items without a word, are in no result; each row of repeated
    ids gives its own rows.
    """
    Store(docs.sparkSession, "leaks")
    parts = []
    for shared in _finders(docs, benchmark, max_edits, recall):

        def make(shared=shared):
            index, names = shared.value
            leaks = make_finder(index)

            def each(batch):
                ids, texts = columns(batch, "doc_id", "text")
                rows = [(ids[row], names[item], edits, len(index.items[item])) for row, item, edits in leaks(texts)]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "edits", "item_words"])

            return each

        parts.append(map_batches(docs.select("doc_id", "text"), LEAKS, make))
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.95) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns; no shuffle."""
    Store(docs.sparkSession, "leaks")
    for shared in _finders(docs, benchmark, max_edits, recall):

        def make(shared=shared):
            leaks = make_finder(shared.value[0])

            def each(batch):
                bad = {row for row, _, _ in leaks(columns(batch, "text")[0])}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)]))

            return each

        docs = map_batches(docs, docs.schema, make)
    return docs
