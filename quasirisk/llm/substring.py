"""Removal of long word sequences that an earlier document has.

Every window of ``width`` words goes to the shard named by the smallest hash of its short
shingles, so equal windows meet; neighbouring windows with the same name travel as one
piece of text.  Only names that occur in two documents are followed up, and equal pieces
travel once.  A shard is a compressed FM-index over its pieces: the Burrows-Wheeler
transform in a wavelet matrix of packed bits.  Backward search streams every piece through
it, word by word from the end, and keeps the matching statistic, capped at the width;
where it reaches the width, the interval of rows tells all documents with that window.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.llm.store import Store, map_batches
from quasirisk.llm.text import SOLID, byte_words, columns, make_hasher

#: Words of the shingles whose hashes name the shard, and windows in one piece at most.
SHINGLE, PIECE_WINDOWS = 8, 64
#: Words in one index; a name with more pieces than HOT is dealt out by whole windows.
INDEX_WORDS, HOT = 1 << 20, 50_000
#: Bytes of text scanned at once.
SLAB = 1 << 20
NO_DOC = (1 << 63) - 1


class FMIndex:
    """Backward search over sequences of integers >= 1."""

    def __init__(self, sequences, width: int):
        import numpy as np

        self.np, self.width = np, width
        n = len(sequences)
        lengths = np.fromiter(map(len, sequences), np.int64, n)
        self.begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        self.lengths = lengths
        total = int(lengths.sum()) + n
        symbols = np.zeros(total, np.int64)
        inside = np.ones(total, bool)
        inside[self.begins + lengths] = False
        symbols[inside] = np.concatenate(sequences) if n else []
        self.symbols = symbols
        rows, prefix_ranks = self._sort(symbols, inside, n, int(lengths.max(initial=0)))
        self.rows = rows
        # Rows whose suffixes share their first ``width`` words form a group.
        half = prefix_ranks[1]
        second = np.minimum(rows + (width - prefix_ranks[0]), total - 1)
        same = (half[rows][1:] == half[rows][:-1]) & (half[second][1:] == half[second][:-1])
        heads = np.nonzero(np.concatenate(([True], ~same)))[0]
        self.group = np.zeros(total, np.int64)
        self.group[heads[1:]] = 1
        self.group = np.cumsum(self.group)
        self.group_begin, self.group_end = heads, np.concatenate((heads[1:], [total]))
        # Transform; ends of sequences are symbol 0, which is never searched.
        bwt = symbols[rows - 1]
        top = int(symbols.max(initial=1))
        self.levels = max(1, top.bit_length())
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        self._wavelet(bwt)
        every = np.arange(top + 1)
        self.first = self.counts[every] - self._walk(every, np.zeros(top + 1, np.int64))

    def _sort(self, symbols, inside, n, longest):
        """Suffix order by prefix doubling, and the ranks of prefixes of half a window or more."""
        np = self.np
        rank = symbols + n
        rank[~inside] = np.arange(n)  # each end differs, so no two suffixes are equal
        length, keep = 1, None
        while True:
            if length * 2 > self.width and keep is None:
                keep = (length, rank)
            ahead = np.zeros(len(rank), np.int64)
            ahead[: len(rank) - length] = rank[length:] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key)
            steps = np.concatenate(([0], (np.diff(key[order]) != 0).astype(np.int64)))
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(steps)
            length *= 2
            if length > longest + 1 and keep is not None:
                return order, keep

    def _wavelet(self, bwt):
        np = self.np
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view("<u8")
            self.bits.append(packed)
            ones = np.cumsum(np.bitwise_count(packed), dtype=np.int64)
            self.ones.append(np.concatenate(([0], ones)).astype(np.uint32))
            self.zeros.append(len(bwt) - int(bit.sum()))
            bwt = np.concatenate((bwt[~bit], bwt[bit]))

    def _walk(self, symbol, at):
        """Where the first ``at`` rows of the transform send ``symbol`` in the last level."""
        np = self.np
        for level in range(self.levels):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[level][block] + np.bitwise_count(self.bits[level][block] & mask).astype(np.int64)
            bit = symbol >> (self.levels - 1 - level) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def matches(self):
        """(sequence, position, group) wherever a window of the full width begins."""
        np = self.np
        order = np.argsort(-self.lengths, kind="stable")
        lengths, begins = self.lengths[order], self.begins[order]
        size, total = len(order), len(self.symbols)
        low, high = np.zeros(size, np.int64), np.full(size, total)
        found = []
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -step, "left"))
            at = lengths[:live] - 1 - step
            symbol = self.symbols[begins[:live] + at]
            both = self._walk(np.concatenate((symbol, symbol)), np.concatenate((low[:live], high[:live])))
            first = self.first[symbol]
            low, high = both[:live] + first, both[live:] + first
            if step + 1 >= self.width:
                # One word more than the width matched: widen to all rows with the same window.
                group = self.group[low]
                low, high = self.group_begin[group], self.group_end[group]
                found.append((order[:live], at, group))
        if not found:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def group_minimum(self, of_sequence):
        """Smallest value of the sequences that have a row in each group."""
        np = self.np
        owner = np.searchsorted(self.begins, self.rows, "right") - 1
        return np.minimum.reduceat(of_sequence[owner], self.group_begin)


def make_scanner(width: int):
    """Function from texts to their pieces: lists of (name, start, windows) for each text."""
    import numpy as np

    hashes = make_hasher(SOLID)
    shingle = min(SHINGLE, width)
    powers = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(shingle)], np.uint64)
    span = width - shingle + 1

    def smallest(values, size):
        """Minimum of each ``size`` neighbours, by doubling."""
        step, at = 1, values
        while step * 2 <= size:
            at = np.minimum(at[:-step], at[step:])
            step *= 2
        return np.minimum(at[: len(at) - (size - step)], at[size - step :]) if size > step else at

    def of_slab(parts):
        raw = b"\n".join(parts)
        words, starts, _ = hashes(raw)
        first = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        out: list[tuple] = [((), (), ())] * len(parts)
        if len(words) < width:
            return out
        n = len(words) - shingle + 1
        shingles = sum(words[i : i + n] * powers[i] for i in range(shingle))
        shingles ^= shingles >> np.uint64(32)
        shingles *= np.uint64(0x9FB21C651E98DF25)
        shingles ^= shingles >> np.uint64(28)
        names = smallest(shingles, span)
        doc = np.repeat(np.arange(len(parts)), np.diff(first))
        valid = doc[: len(names)] == doc[width - 1 :]
        change = np.concatenate(([True], (names[1:] != names[:-1]) | (doc[1 : len(names)] != doc[: len(names) - 1])))
        index = np.arange(len(names))
        run = np.maximum.accumulate(np.where(change, index, 0))
        heads = np.nonzero(valid & (change | ((index - run) % PIECE_WINDOWS == 0)))[0]
        # Windows of a text are valid from its first word on, so a piece ends with the next
        # head or with the text's last window.
        last = first[doc[heads] + 1] - width + 1
        ends = np.minimum(np.concatenate((heads[1:], [len(names)])), last)
        where = np.searchsorted(heads, first)
        name, begin, count = names[heads].view(np.int64), heads - first[doc[heads]], ends - heads
        for i in range(len(parts)):
            a, b = where[i], where[i + 1]
            if b > a:
                out[i] = (name[a:b], begin[a:b], count[a:b])
        return out

    def scan(raws):
        group, held = [], 0
        for raw in raws:
            if group and held + len(raw) > SLAB:
                yield from of_slab(group)
                group, held = [], 0
            group.append(raw)
            held += len(raw)
        if group:
            yield from of_slab(group)

    return scan


def make_matcher(width: int):
    """Function from pieces and their first documents to the first document of each window."""
    import numpy as np

    hashes = make_hasher(SOLID)

    def match(pieces: list[str], first_docs: list[int]) -> list:
        raws = [p.encode() for p in pieces]
        words, starts, _ = hashes(b"\n".join(raws))
        cuts = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws]))
        ids = np.unique(words, return_inverse=True)[1] + 1
        index = FMIndex(np.split(ids, cuts[:-1]), width)
        piece, at, group = index.matches()
        source = index.group_minimum(np.array(first_docs, np.int64))[group]
        order = np.lexsort((at, piece))
        piece, source = piece[order], source[order]
        return np.split(source, np.searchsorted(piece, np.arange(1, len(pieces))))

    return match


def _scan(docs: DataFrame, width: int) -> DataFrame:
    schema = "doc_id long, key string, n_words long, words_sha256 string, pieces array<struct<name:long,start:int,windows:int>>"
    piece = pa.struct([("name", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])

    def make():
        scan = make_scanner(width)

        def each(batch):
            ids, keys, texts = columns(batch, "doc_id", "key", "text")
            words = [byte_words(t) for t in texts]
            raws = [b" ".join(w) for w in words]
            lists = list(scan(raws))
            sizes = [0]
            for names, _, _ in lists:
                sizes.append(sizes[-1] + len(names))
            flat = [[int(x) for part in lists for x in part[i]] for i in range(3)]
            values = pa.StructArray.from_arrays([pa.array(f, t.type) for f, t in zip(flat, piece, strict=True)], fields=list(piece))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys), pa.array([len(w) for w in words], pa.int64()),
                 pa.array([hashlib.sha256(r).hexdigest() for r in raws]),
                 pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)],
                names=["doc_id", "key", "n_words", "words_sha256", "pieces"],
            )

        return each

    return map_batches(docs, schema, make)


def _cut(suspects: DataFrame, width: int) -> DataFrame:
    """One row per piece with its words; pieces of hot names come as single windows."""
    schema = "doc_id long, key string, start int, name long, piece string"

    def make():
        import xxhash

        def each(batch):
            rows = []
            for doc_id, key, text, pieces in zip(*columns(batch, "doc_id", "key", "text", "pieces"), strict=True):
                words = byte_words(text)
                for p in pieces:
                    start, size = p["start"], p["windows"]
                    if not p["hot"]:
                        rows.append((doc_id, key, start, p["name"], b" ".join(words[start : start + size + width - 1]).decode()))
                        continue
                    for at in range(start, start + size):
                        window = b" ".join(words[at : at + width])
                        name = xxhash.xxh64_intdigest(window, 1) - (1 << 63)
                        rows.append((doc_id, key, at, name, window.decode()))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string())
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "start", "name", "piece"])

        return each

    return map_batches(suspects, schema, make)


def _sources(pieces: DataFrame, width: int) -> DataFrame:
    """For each distinct piece the runs of windows that an earlier document may have."""
    schema = "name long, digest string, runs array<struct<low:int,high:int,source:long>>"
    run = pa.struct([("low", pa.int32()), ("high", pa.int32()), ("source", pa.int64())])
    shards = pieces.repartition("name").sortWithinPartitions("name")

    def work(batches):
        match = make_matcher(width)

        def flush(rows):
            import numpy as np

            names, digests, lists = [], [], []
            for (name, digest, _, low, high), source in zip(rows, match([r[2] for r in rows], [r[3] for r in rows]), strict=True):
                if not len(source) or int(source.min()) >= high:
                    continue
                edges = np.concatenate(([0], np.nonzero(np.diff(source))[0] + 1, [len(source)])).tolist()
                runs = [(a, b, int(source[a])) for a, b in zip(edges, edges[1:], strict=False) if source[a] < high]
                names.append(name)
                digests.append(digest)
                lists.append([dict(zip(("low", "high", "source"), r, strict=True)) for r in runs])
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(digests, pa.string()), pa.array(lists, pa.list_(run))],
                names=["name", "digest", "runs"],
            )

        rows, held, last = [], 0, None
        for batch in batches:
            for row in zip(*columns(batch, "name", "digest", "piece", "low", "high"), strict=True):
                # An index ends between names, so equal windows are always in the same one.
                if held >= INDEX_WORDS and row[0] != last:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += row[2].count(" ") + 1
                last = row[0]
        if rows:
            yield flush(rows)

    return shards.select("name", "digest", "piece", "low", "high").mapInArrow(work, schema)


def _remove(rows: DataFrame, width: int) -> DataFrame:
    """n_removed and kept_sha256 of texts with the starts of windows to remove."""
    schema = "doc_id long, key string, n_removed long, kept_sha256 string"

    def make():
        def each(batch):
            ids, keys, texts, spans = columns(batch, "doc_id", "key", "text", "spans")
            removed, digests = [], []
            for text, runs in zip(texts, spans, strict=True):
                words = byte_words(text)
                kept, end = [], 0
                for low, high in sorted((r["low"], r["high"] + width - 1) for r in runs):
                    if low > end:
                        kept += words[end:low]
                    end = max(end, high)
                kept += words[end:]
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys), pa.array(removed, pa.int64()), pa.array(digests)],
                names=["doc_id", "key", "n_removed", "kept_sha256"],
            )

        return each

    return map_batches(rows, schema, make)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row per row of ``docs``.

    A word goes if a window of ``width`` words that covers it also starts in a row with a
    smaller doc_id.  NULL ids are larger than all others; rows with equal ids do not remove
    each other's words.  NULL and empty texts have no words.  ``kept_sha256`` is the digest of
    the kept words joined by one space.
    """
    spark = docs.sparkSession
    store = Store(spark, "substring")
    order = F.coalesce(F.col("doc_id"), F.lit(NO_DOC))
    keyed = docs.select(order.alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), "text")
    scanned = store.keep(_scan(keyed, width), "scanned")

    # Of equal texts only the first goes on; a later one is covered as a whole.
    firsts = scanned.filter(f"n_words >= {width}").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    light = scanned.join(firsts, ["key", "doc_id"], "left_semi").select("key", "doc_id", F.inline("pieces"))
    met = light.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    met = met.filter("low < high").select("name", (F.col("n") > HOT).alias("hot"))
    piece = F.struct("name", "start", "windows", "hot")
    wanted = light.join(met, "name").groupBy("key", "doc_id").agg(F.collect_list(piece).alias("pieces"))
    suspects = store.keep(keyed.join(wanted, ["key", "doc_id"]), "suspects")

    cut = store.keep(_cut(suspects, width), "cut")
    digest = F.md5(F.col("piece").cast("binary")).alias("digest")
    distinct = cut.groupBy("name", "piece").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    sources = store.keep(_sources(distinct.select("name", digest, "piece", "low", "high"), width), "sources")
    places = cut.select("doc_id", "key", "start", "name", digest).join(sources, ["name", "digest"])
    places = places.select("doc_id", "key", "start", F.inline("runs")).filter("source < doc_id")
    span = F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
    spans = places.groupBy("key", "doc_id").agg(F.collect_list(span).alias("spans"))
    texts = suspects.select("doc_id", "key", "text")
    partly = store.keep(_remove(texts.join(spans, ["key", "doc_id"]), width).distinct(), "partly")
    store.drop("cut")

    whole = scanned.select("doc_id", "key", "n_words", "words_sha256")
    whole = whole.join(firsts.select("key", F.col("doc_id").alias("first_")), "key", "left").join(partly, ["key", "doc_id"], "left")
    copy = F.coalesce(F.col("first_") < F.col("doc_id"), F.lit(False))
    return whole.select(
        F.when(F.col("doc_id") != NO_DOC, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )
