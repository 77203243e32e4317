"""Links between the tokens that two tokenizers cut from the same text.

Each tokenisation is a token-byte incidence matrix in compressed sparse rows.  The product
of one with the transpose of the other, row by row, has an entry wherever two tokens
overlap: its value is the number of bytes they share.  Offsets where tokens of both sides
end cut the text into groups; the product of the token-group matrices has an entry wherever
two tokens share a group.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.llm.store import Store, map_batches
from quasirisk.llm.text import columns, slabs

#: Neither vocabulary has a token that goes on behind a single space between other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Characters that all versions of the pattern's classes treat alike.
_LATIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*+")
#: Parts a worker remembers the links of, their greatest length, texts looked up together, and
#: new parts that are tokenised in one go.
CACHE, CACHED_CHARS, GROUP, JOINED = 150_000, 64, 64, 512
#: Characters of texts in one batch of results.
BATCH_CHARS = 1 << 20
#: Bytes of text whose matrices are made at once.
SLAB = 1 << 20
#: Pairs looked up by broadcast hold more than this share of all links, so there are fewer than that.
FREQUENT = 1 << 20
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class Csr:
    """Sparse matrix: row i holds ``values`` at ``columns`` from starts[i] to starts[i + 1]."""

    starts: object
    columns: object
    values: object
    width: int

    def transposed(self) -> Csr:
        import numpy as np

        order = np.argsort(self.columns, kind="stable")
        sizes = np.bincount(self.columns, minlength=self.width)
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        return Csr(np.concatenate(([0], np.cumsum(sizes))), rows[order], self.values[order], len(self.starts) - 1)


def incidence(columns_, sizes, width: int) -> Csr:
    """Rows of ones; row i has ``sizes[i]`` of the columns."""
    import numpy as np

    return Csr(np.concatenate(([0], np.cumsum(sizes))), columns_, np.ones(len(columns_), np.int64), width)


def byte_incidence(lengths) -> Csr:
    """Token-byte matrix of a tokenisation with these token lengths."""
    import numpy as np

    total = int(lengths.sum())
    return incidence(np.arange(total), lengths, total)


def product_sizes(left: Csr, right: Csr):
    """Terms of each row of the product before equal columns are added up."""
    import numpy as np

    terms = np.concatenate(([0], np.cumsum(np.diff(right.starts)[left.columns])))
    return terms[left.starts[1:]] - terms[left.starts[:-1]]


def product(left: Csr, right: Csr) -> Csr:
    """Row products after Gustavson: each entry of a left row scales a row of ``right``."""
    import numpy as np

    sizes = np.diff(right.starts)[left.columns]
    begins = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(begins - right.starts[left.columns], sizes)
    row = np.repeat(np.repeat(np.arange(len(left.starts) - 1), np.diff(left.starts)), sizes)
    column, value = right.columns[at], np.repeat(left.values, sizes) * right.values[at]
    key = row * right.width + column
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, row, column, value = key[order], row[order], column[order], value[order]
    heads = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.zeros(0, np.int64)
    summed = np.add.reduceat(value, heads) if len(heads) else value
    starts = np.searchsorted(row[heads], np.arange(len(left.starts)))
    return Csr(starts, column[heads], summed, right.width)


@dataclass(frozen=True)
class Alignment:
    """Links (a, b) by token position with the bytes they share, and the group of each token."""

    a: object
    b: object
    shared_bytes: object
    group_a: object
    group_b: object
    cuts: object

    def _groups(self) -> tuple[Csr, Csr]:
        import numpy as np

        width = len(self.cuts)
        of_a, of_b = (incidence(g, np.ones(len(g), np.int64), width) for g in (self.group_a, self.group_b))
        return of_a, of_b.transposed()

    def group_links(self):
        """(a, b) of all tokens that share a group, as positions; all at once."""
        import numpy as np

        linked = product(*self._groups())
        return np.repeat(np.arange(len(linked.starts) - 1), np.diff(linked.starts)), linked.columns

    def group_link_counts(self):
        """Shared-group links of each token of the first side, without making them."""
        return product_sizes(*self._groups())


def align(a_lengths, b_lengths) -> Alignment:
    """Links of two tokenisations of the same bytes, given the lengths of their tokens (all > 0)."""
    import numpy as np

    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    found = []
    low = 0
    while low < len(cuts):
        # No link crosses a cut, so a long text goes in sections between cuts.
        begin = int(cuts[low - 1]) if low else 0
        low = max(low + 1, int(np.searchsorted(cuts, begin + SLAB, "right")))
        end = int(cuts[low - 1])
        a0, a1 = np.searchsorted(a_ends, (begin, end), "right")
        b0, b1 = np.searchsorted(b_ends, (begin, end), "right")
        linked = product(byte_incidence(a_lengths[a0:a1]), byte_incidence(b_lengths[b0:b1]).transposed())
        rows = np.repeat(np.arange(a1 - a0), np.diff(linked.starts))
        found.append((rows + a0, linked.columns + b0, linked.values))
    empty = np.zeros(0, np.int64)
    a, b, shared = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty, empty)
    return Alignment(a, b, shared, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), cuts)


def byte_level_bytes() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_byte_level(path: str):
    """Function from texts to id lists, and the bytes of each id.

    Where ids are in the order of the merges, texts of ASCII and Latin letters go to a faster
    encoder over the same vocabulary, merges and pattern; all others to the tokenizer itself.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of = byte_level_bytes()
    raw = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        raw[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    in_order = [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged)))
    fast = None
    if in_order:
        ranks = {raw[i]: i for i in range(256 + len(merged))}
        fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts):
        return [
            fast.encode_ordinary(t) if fast and _LATIN.fullmatch(t) else tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids
            for t in texts
        ]

    return encode, raw


def load_pieces(path: str):
    """Function from texts to id lists, and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    raw = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        raw.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return (lambda texts: model.encode(texts, num_threads=1)), raw


class Cache:
    """Parts and what is known of them; when full, only parts that come again are taken over."""

    def __init__(self, size: int):
        self.size, self.old = size, None
        self._clear()

    def _clear(self) -> None:
        import numpy as np

        self.where: dict[str, int] = {}
        self.words: list[str] = []
        self.pairs: list[bytes] = []
        self.counts = np.zeros((self.size, 5), np.int32)

    def reserve(self, n: int) -> None:
        """Room for ``n`` more; indices from before a call are void after it."""
        if len(self.words) + n > self.size:
            self.old = (self.where, self.words, self.pairs, self.counts)
            self.size = max(CACHE, n)
            self._clear()

    def add(self, parts: list[str], counts, words: list[str], pairs: list[bytes]) -> None:
        at = len(self.words)
        self.where.update(zip(parts, range(at, at + len(parts)), strict=True))
        self.counts[at : at + len(parts)] = counts
        self.words += words
        self.pairs += pairs

    def take_over(self, parts: list[str]) -> list[str]:
        """Those of ``parts`` that are not known from before either."""
        if self.old is None:
            return parts
        where, words, pairs, counts = self.old
        places = list(map(where.get, parts))
        found = [k for k in places if k is not None]
        again = [p for p, k in zip(parts, places, strict=True) if k is not None]
        self.add(again, counts[found], [words[k] for k in found], [pairs[k] for k in found])
        return [p for p, k in zip(parts, places, strict=True) if k is None]


def make_aligner(a_path: str, b_path: str):
    """Function from texts to (n_a, n_b, groups, links, shared-group links, groups text, links).

    The last is packed id pairs, one for each link.  None for texts without tokens.  Parts
    between single spaces are aligned once per worker as long as the cache has room.
    """
    import numpy as np

    encode_a, bytes_a = load_byte_level(a_path)
    encode_b, bytes_b = load_pieces(b_path)
    sizes_a, sizes_b = (np.array(list(map(len, raw)), np.int64) for raw in (bytes_a, bytes_b))
    names = np.array([str(i) for i in range(max(len(bytes_a), len(bytes_b)))], object)
    marked = [names, names + ",", names + "|", names + ";"]
    cache = Cache(CACHE)

    def tokens(text: str):
        """Ids of both sides, or None if they do not give back the text behind a space."""
        ids_a, ids_b = encode_a([" " + text])[0], encode_b([text])[0]
        raw = b" " + text.encode()
        if b"".join([bytes_a[t] for t in ids_a]) != raw or b"".join([bytes_b[t] for t in ids_b]) != raw:
            return None
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64)

    def learn(parts: list[str]) -> None:
        """Add parts to the cache; the counts of a part without tokens are -1."""
        parts = sorted(parts, key=lambda p: _LATIN.fullmatch(p) is None)
        for at in range(0, len(parts), JOINED):
            some = parts[at : at + JOINED]
            # Parts meet at single spaces, where both sides cut, as they do in the texts.
            whole = tokens(" ".join(some)) if len(some) > 1 and not any(p[0].isspace() or p[-1].isspace() for p in some if p) and all(some) else None
            if whole is not None:
                add(some, *whole)
                continue
            for part in some:
                whole = tokens(part)
                if whole is None:
                    cache.add([part], -1, [""], [b""])
                else:
                    add([part], *whole)

    def add(parts: list[str], a, b) -> None:
        linked = align(sizes_a[a], sizes_b[b])
        raw_ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        # Cuts, and tokens of either side, up to the end of each part.
        group_ends = np.searchsorted(linked.cuts, raw_ends, "right")
        a_ends = np.searchsorted(linked.group_a, group_ends, "left")
        b_ends = np.searchsorted(linked.group_b, group_ends, "left")
        if (linked.cuts[group_ends - 1] != raw_ends).any():
            raise ValueError("a token goes on behind a single space")
        # Tokens of both sides by group, then side.
        key = np.concatenate((linked.group_a * 2, linked.group_b * 2 + 1))
        order = np.argsort(key, kind="stable")
        key = key[order]
        ends = a_ends + b_ends
        gap = np.concatenate((np.where(key[1:] == key[:-1], 1, np.where(key[1:] >> 1 == key[:-1] >> 1, 2, 3)), [0]))
        gap[ends - 1] = 0
        ids = np.concatenate((a, b))[order]
        text = np.empty(len(ids), object)
        for mark in range(4):
            of = gap == mark
            text[of] = marked[mark][ids[of]]
        text = text.tolist()
        pairs = (a[linked.a] << 32 | b[linked.b]).tobytes()
        link_ends = np.searchsorted(linked.a, a_ends, "left")
        shared = np.concatenate(([0], np.cumsum(linked.group_link_counts())))[a_ends]
        counts = np.diff(np.stack((a_ends, b_ends, group_ends, link_ends, shared)), prepend=0).T
        ends, link_ends = [0, *ends.tolist()], [0, *(8 * link_ends).tolist()]
        words = ["".join(text[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
        cache.add(parts, counts, words, [pairs[i:j] for i, j in zip(link_ends, link_ends[1:], strict=False)])

    def of_texts(texts):
        out = []
        for at in range(0, len(texts), GROUP):
            group = [_CUT.split(t) if t else [] for t in texts[at : at + GROUP]]
            known = [list(map(cache.where.get, parts)) for parts in group]
            missing = list({p for parts, found in zip(group, known, strict=True) if None in found for p, k in zip(parts, found, strict=True) if k is None})
            if missing:
                before = cache.where
                cache.reserve(len(missing))
                if cache.where is not before:
                    # The cache begins anew: all parts of this group have to come over.
                    missing = list({p for parts in group for p in parts})
                    cache.reserve(len(missing))
                learn(cache.take_over(missing))
                known = [list(map(cache.where.get, parts)) for parts in group]
            words, pairs = cache.words.__getitem__, cache.pairs.__getitem__
            for found in known:
                counts = cache.counts[np.array(found, np.int64)]
                if not found or counts[:, 0].min() < 0:
                    out.append(None)
                    continue
                out.append((*counts.sum(axis=0, dtype=np.int64).tolist(), ";".join(map(words, found)), b"".join(map(pairs, found))))
            for p in missing:
                if len(p) > CACHED_CHARS:
                    k = cache.where.pop(p)
                    cache.words[k], cache.pairs[k] = "", b""
        return out

    return of_texts


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups string,"
    " pairs array<long>, times array<int>"
)


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignment of each text under a byte-level vocabulary (a) and a piece vocabulary (b).

    One row per row of (doc_id, text): tokens, groups, overlap links and shared-group links;
    ``groups`` lists the ids of each group as ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the
    distinct linked ids, a << 32 | b, and ``times`` how often each is linked here.  NULL and
    empty texts, and texts that a vocabulary does not give back byte by byte behind one
    space, have no tokens: zeros, an empty ``groups`` and no pairs.  A projection, without a
    shuffle; NULL and repeated ids are rows like any other, other columns are ignored.
    """

    def make():
        import numpy as np

        aligned = make_aligner(a_path, b_path)

        def each(batch):
            ids, texts = columns(batch, "doc_id", "text")
            for low, high in slabs(texts, BATCH_CHARS):
                yield results(ids[low:high], texts[low:high])

        def results(ids, texts):
            figures, groups, pairs, times, sizes = [], [], [], [], [0]
            for one in aligned(texts):
                figures.append(one[:5] if one else (0,) * 5)
                groups.append(one[5] if one else "")
                pair, n = np.unique(np.frombuffer(one[6] if one else b"", np.int64), return_counts=True)
                pairs.append(pair)
                times.append(n)
                sizes.append(sizes[-1] + len(pair))
            ends = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
            counts = [pa.array(c, pa.int64()) for c in zip(*figures, strict=True)]
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "pairs", "times"]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *counts, pa.array(groups), *lists], names=names)

        return each

    return map_batches(docs.select("doc_id", "text"), ALIGNED, make)


def pair_counts(aligned: DataFrame, store: Store) -> DataFrame:
    """pair, n, best: links of each id pair in the corpus, and whether its b id has no pair with more."""
    links = aligned.select(F.inline(F.arrays_zip("pairs", "times")))
    counts = store.keep(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "counts")
    side = F.col("pair").bitwiseAND(F.lit(_LOW)).alias("b")
    # One row per id of a vocabulary.
    most = F.broadcast(counts.groupBy(side).agg(F.max("n").alias("most")))
    flagged = counts.withColumn("b", side).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return store.keep(flagged, "flagged")


def score_links(aligned: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Add n_best and count_sum to the rows of ``align_documents``; pairs and times go.

    ``n_best`` counts links whose pair is the most frequent of its b id in the corpus, ties
    included; ``count_sum`` adds up the corpus counts of the pairs of all links.  Pairs with
    more than 1/``frequent`` of all links, fewer than ``frequent`` of them, are looked up by
    broadcast; the rest, none of them held by many rows, by a join.
    """
    spark = aligned.sparkSession
    store = Store(spark, "align")
    kept = store.keep(aligned.withColumn("row_", F.monotonically_increasing_id()), "aligned")
    flagged = pair_counts(kept, store)
    total = flagged.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > F.lit(total) / frequent
    top = flagged.filter(often).sort("pair").toArrow()
    sent = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    base = [c for c in kept.columns if c not in ("pairs", "times")]
    schema = kept.select(*base, F.lit(0).cast("long").alias("best_"), F.lit(0).cast("long").alias("sum_"), F.col("pairs").alias("pair_"), F.col("times").alias("times_")).schema

    def look_up(batches):
        import numpy as np

        known, n, best = sent.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            pairs = lists.flatten().to_numpy()
            sizes = np.asarray(lists.value_lengths())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            ends = np.concatenate(([0], np.cumsum(sizes)))

            def by_row(values, ends=ends):
                added = np.concatenate(([0], np.cumsum(values)))
                return added[ends[1:]] - added[ends[:-1]]

            count = np.where(hit, n[at] if len(known) else 0, 0)
            flags = np.where(hit, best[at] if len(known) else False, False)
            rest = np.bincount(row[~hit], minlength=len(sizes))
            offsets = pa.array(np.concatenate(([0], np.cumsum(rest))), pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in ((pairs[~hit], pa.int64()), (times[~hit], pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in base), pa.array(by_row(flags * times)), pa.array(by_row(count * times)), *left],
                names=[*base, "best_", "sum_", "pair_", "times_"],
            )

    first = store.keep(kept.mapInArrow(look_up, schema), "looked_up")
    sent.destroy()
    store.drop("aligned")
    rest = first.select("row_", F.inline(F.arrays_zip("pair_", "times_"))).withColumnRenamed("pair_", "pair")
    rest = rest.join(flagged.filter(~often), "pair").groupBy("row_").agg(
        F.sum(F.when(F.col("best"), F.col("times_")).otherwise(0)).alias("more_best_"), F.sum(F.col("n") * F.col("times_")).alias("more_sum_")
    )
    joined = first.join(rest, "row_", "left")
    return joined.select(
        *[c for c in base if c != "row_"],
        (F.col("best_") + F.coalesce("more_best_", F.lit(0))).alias("n_best"),
        (F.col("sum_") + F.coalesce("more_sum_", F.lit(0))).alias("count_sum"),
    )
