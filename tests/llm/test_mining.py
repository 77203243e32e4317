"""Hard negatives, token alignment and source mixing against brute force."""

import hashlib
import heapq
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quasirisk.llm import align
from quasirisk.llm.align import align_documents, score_links
from quasirisk.llm.mixing import mix_sources
from quasirisk.llm.negatives import fill_windows, hard_negatives, inner_products, pack_key, unpack_key

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def mined(rows):
    """All windows, every pair compared, in whole numbers."""
    whole = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    found = Counter()
    last = (1 << 63) - 1
    for n, (anchor, a, label) in enumerate(whole):
        if anchor is None or anchor % 100:
            continue
        scores = [(max(-last, min(last, sum(x * y for x, y in zip(a, b, strict=False)))), i, k) for m, (i, b, k) in enumerate(whole) if m != n]
        scores.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        for p, i, _ in [s for s in scores if s[2] == label][:5]:
            inside = [s for s in scores if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:5]
            found.update((anchor, i, rank, j, p, s) for rank, (s, j, _) in enumerate(inside, 1))
    return found


@pytest.mark.parametrize("block_bytes", [32 << 20, 700])
def test_hard_negatives(spark, block_bytes):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 9, 6) / 16], int(rng.integers(0, 3))) for i in range(-200, 500)]
    rows += [(0, rows[200][1], rows[200][2])] * 2 + [(300, rows[3][1], 1), (None, rows[5][1], 0), (None, rows[5][1], 1), (None, None, 0)]
    rows += [(100, [1.0] * 6, None), (600, None, 1), (700, [1.0, None, 1.0], 0), (800, [NAN] * 6, 1), (900, [INF] * 6, 1)]
    rows += [(1000, [], 1), (1100, [0.5, 0.5], 0), (1200, [0.5] * 9, 2), (1300, [0.0] * 6, 1)] + [(2000 + i, [0.5] * 6, i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in ("row", "q", "anchor", "score", "place")})
    got = Counter(tuple(r) for r in hard_negatives(frame.repartition(5), block_bytes=block_bytes).collect())
    assert got == mined(rows) and len(got) > 100


def test_hard_negatives_of_huge_and_no_vectors(spark):
    rows = [(100 * i, [1e30 * (1 - 2 * (i % 2)), 3e37], i % 2) for i in range(6)]
    got = Counter(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == mined(rows)
    for nothing in (rows[:0], [(1, [1.0], 0)], [(100, None, None)]):
        assert hard_negatives(spark.createDataFrame(nothing, VECTORS)).count() == 0


def test_keys_sort_as_their_parts():
    parts = [(a, s, p, i, r) for a in (0, 1 << 40) for s in (-9, 0, 7) for p in (True, False) for i in (-5, 0, 9, None) for r in (0, 3)]
    by_bytes = sorted(parts, key=lambda x: pack_key(*x))
    assert by_bytes == sorted(parts, key=lambda x: (x[0], -x[1], not x[2], x[3] is None, x[3] or 0, x[4]))
    assert all(unpack_key(pack_key(*x)) == x[:4] for x in parts)


def test_windows_close_when_full():
    rows = [(pack_key(1, 100, True, 1, 1), 7)] + [(pack_key(1, s, False, s, s), 7) for s in (100, 99, 85, 80, 79)]
    assert [r[2:4] for r in fill_windows(rows, 2)] == [(1, 100), (2, 99)]
    assert [r[3] for r in fill_windows(rows, 9)] == [100, 99, 85, 80]


def test_products_are_exact():
    a = np.array([[2.0**60, 1, 3], [2.0**61, 5, -1]])
    assert inner_products(a[:, 1:], a[:, 1:]).tolist() == [[10, 2], [2, 26]]
    assert inner_products(a, np.array([[2.0, 1, 1], [8.0, 0, 0]])).tolist() == [[2**61 + 4, (1 << 63) - 1], [2**62 + 4, (1 << 63) - 1]]


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [" ", "  a  b\n c ", "x<|endoftext|>y </s>", "a▁b", "漢字 \U0001f600 é\x00 ok\r\n\tq", "q" * 3000, "a 　 b  c \x1c d", "'s 'll it's"]


def spans(tokens):
    ends = np.cumsum([0, *map(len, tokens)]).tolist()
    return list(zip(ends, ends[1:], strict=False))


def aligned(pairs):
    """Links and groups of each text, token by token."""
    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    of, out = align.byte_level_bytes(), []
    for doc_id, text in pairs:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(of[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + (text or "")).encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            out.append((doc_id, [], [], [], ""))
            continue
        sa, sb, links, at = spans(a_bytes), spans(b_bytes), [], 0
        for i, (s, e) in enumerate(sa):
            while sb[at][1] <= s:
                at += 1
            j = at
            while j < len(sb) and sb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups = defaultdict(lambda: ([], []))
        for side, (ids, where) in enumerate(((a, sa), (b, sb))):
            for i, cut in zip(ids, np.searchsorted(cuts, [e for _, e in where]).tolist(), strict=True):
                groups[cuts[cut]][side].append(str(i))
        out.append((doc_id, a, b, links, ";".join(",".join(groups[c][0]) + "|" + ",".join(groups[c][1]) for c in cuts)))
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_alignment(spark, docs, pairs, monkeypatch, frequent):
    extra = list(enumerate(TEXTS, 800001)) + [(800001, TEXTS[0]), (None, "hi")]
    given = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    given = given.withColumns({c: F.lit(c) for c in ("row_", "pair", "n", "groups")})
    rows = aligned([(i, t) for i, t in pairs] + extra)
    counts = Counter(p for r in rows for p in r[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter(
        (i, len(a), len(b), g.count("|"), len(l), sum(counts[p] == most[p[1]] for p in l), sum(counts[p] for p in l), g) for i, a, b, l, g in rows
    )
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    got = Counter(tuple(r[n] for n in names) for r in score_links(align_documents(given, A, B), frequent).collect())
    assert got == want


def test_sparse_products():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 2, (7, 9)) * rng.integers(1, 5, (7, 9)), rng.integers(0, 2, (9, 5))

    def csr(m):
        rows, columns = np.nonzero(m)
        return align.Csr(np.searchsorted(rows, np.arange(len(m) + 1)), columns, m[rows, columns], m.shape[1])

    def dense(c):
        out = np.zeros((len(c.starts) - 1, c.width), int)
        for i in range(len(out)):
            out[i, c.columns[c.starts[i] : c.starts[i + 1]]] = c.values[c.starts[i] : c.starts[i + 1]]
        return out

    assert (dense(align.product(csr(left), csr(right))) == left @ right).all()
    assert (dense(csr(left).transposed()) == left.T).all()


def test_links_in_sections(monkeypatch):
    rng = np.random.default_rng(4)
    a = rng.integers(1, 6, 400)
    b = rng.integers(1, 6, 400)
    a, b = np.append(a, max(1, b.sum() - a.sum() + 1)), np.append(b, max(1, a.sum() - b.sum() + 1))
    total = min(a.sum(), b.sum())
    assert a.sum() == b.sum() == total
    whole = align.align(a, b)
    monkeypatch.setattr(align, "SLAB", 16)
    cut = align.align(a, b)
    for x, y in ((whole.a, cut.a), (whole.b, cut.b), (whole.shared_bytes, cut.shared_bytes)):
        assert x.tolist() == y.tolist()
    assert whole.shared_bytes.sum() == total
    i, j = whole.group_links()
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in range(len(a)) for y in range(len(b)) if whole.group_a[x] == whole.group_b[y]]
    assert np.bincount(i, minlength=len(a)).tolist() == whole.group_link_counts().tolist()


def apportioned(votes, seats):
    """Sainte-Laguë, seat by seat."""
    heap = [(-v, k) for k, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    won = [0] * len(votes)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * won[k] + 1), k))
    return won


def shared_out(sizes, weights, limit):
    """Targets by resharing the excess of full sources until none is above."""
    left, targets, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = left / sum(weights[k] for k in open_)
        full = {k for k in open_ if level * weights[k] >= limit * sizes[k]}
        if not full:
            for k in open_:
                targets[k] = level * weights[k]
            break
        for k in full:
            targets[k] = limit * sizes[k]
            left -= targets[k]
        open_ -= full
    return targets


ODD_SOURCES = [
    (-1, None, "tiny"), (-2, "", None), (-3, "a b c d e f g", None), (-4, "one two", "Zed"), (-5, "x " * 2000, "zz"),
    (-5, "x " * 2000, "zz"), (None, "p q r", None), (-6, None, ""), (-7, "é 　 ü", "ü"),
]


@pytest.mark.parametrize("shard_rows", [256, 5])
def test_source_mix(spark, sf_dir, shard_rows):
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    given = given.union(spark.createDataFrame(ODD_SOURCES, "doc_id long, text string, source string"))
    clash = {c: F.lit(1) for c in ("cell", "group", "size", "rank_", "quota", "copies")}
    rows = mix_sources(given.withColumns(clash).repartition(7), shard_rows=shard_rows).collect()
    again = mix_sources(given.repartition(2, "source"), shard_rows=shard_rows).collect()
    key = lambda r: (r["doc_id"], r["source"], r["size"], r["source_size"], r["target"], r["taken"])
    assert Counter(map(key, rows)) == Counter(map(key, again))
    sizes = Counter((r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in given.collect())
    assert Counter(key(r)[:3] for r in rows) == sizes
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, (s or "").encode()))
    held = [sum(n * k for (_, s, n), k in sizes.items() if s == name) for name in names]
    targets = shared_out(held, [1 + k % 3 for k in range(len(names))], 3)
    taken = Counter()
    for r in rows:
        k = names.index(r["source"])
        assert r["source_size"] == held[k] and r["target"] == pytest.approx(targets[k], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[k] += r["taken"]
    for k, target in enumerate(targets):
        assert abs(taken[k] - target) <= 1 + 0.005 * target


def test_apportionment(spark, tmp_path):
    from quasirisk.llm.mixing import apportion
    from quasirisk.llm.store import Store

    rng = np.random.default_rng(8)
    groups = [([5, 5, 5], 4), ([1], 7), ([100, 1, 1, 1], 3), ([53, 24, 23], 7), ([2, 2], 1), ([0, 0], 5), ([3, 0], 0)]
    groups += [(rng.integers(0, 10 ** int(rng.integers(1, 7)), int(rng.integers(1, 40))).tolist(), int(rng.integers(1, 300))) for _ in range(30)]
    rows = [(g, k, v, n) for g, (votes, n) in enumerate(groups) for k, v in enumerate(votes)]
    frame = spark.createDataFrame(rows, "group long, cell long, votes long, total long")
    got = {(r["group"], r["cell"]): r["seats"] for r in apportion(frame, Store(spark, "seats"), "seats").collect()}
    for g, (votes, n) in enumerate(groups):
        assert [got.get((g, k), 0) for k in range(len(votes))] == apportioned(votes, n)


def test_mixing_and_alignment_of_odd_and_empty_tables(odd, no_docs):
    assert score_links(align_documents(odd, A, B)).count() == odd.count()
    assert score_links(align_documents(no_docs, A, B)).count() == 0
    mixed = mix_sources(odd.withColumn("source", F.col("lang")))
    assert mixed.count() == odd.count()
    assert mix_sources(no_docs.withColumn("source", F.col("lang"))).count() == 0
    assert mix_sources(odd.withColumn("source", F.lit(None).cast("string")).withColumn("text", F.lit(""))).agg(F.sum("taken")).first()[0] == 0
    digest = hashlib.sha256(b"").hexdigest()
    assert digest not in [r["groups"] for r in align_documents(odd, A, B).select("groups").collect()]
