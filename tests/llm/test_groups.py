"""Near duplicates, repeated passages and benchmark passages against brute force."""

import hashlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quasirisk.llm import substring
from quasirisk.llm.decontaminate import drop_leaks, find_leaks
from quasirisk.llm.simhash import keep_one_of_each, near_duplicates
from quasirisk.llm.substring import remove_repeats


def simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 4]), 42) for j in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fingerprints):
    """Root by fingerprint, every pair compared."""
    distinct, root = sorted(set(fingerprints)), {}
    for f in distinct:
        root[f] = f

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(distinct):
        for g in distinct[:i]:
            if (f ^ g).bit_count() <= 4:
                root[top(f)] = top(g)
    return {f: top(f) for f in distinct}


def test_simhash_components(docs, pairs):
    prints = [(i, simhash(t)) for i, t in pairs]
    roots = components([f for _, f in prints])
    low = {}
    for i, f in prints:
        low[roots[f]] = min((x for x in (low.get(roots[f]), i) if x is not None), default=None)
    want = Counter((i, f"{f:016x}", low[roots[f]]) for i, f in prints)
    assert Counter(tuple(r) for r in near_duplicates(docs).collect()) == want
    kept = Counter(r["doc_id"] for r in keep_one_of_each(docs).collect())
    assert kept == Counter(low.values())


def test_simhash_odd_and_empty(odd, no_docs):
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == near_duplicates(odd).select("component_id").distinct().count()
    assert near_duplicates(no_docs).count() == keep_one_of_each(no_docs).count() == 0


def plain_removal(rows, width):
    first, words = {}, [(i, t.encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            first[key] = min(i, first.get(key, i))
    out = Counter()
    for i, w in words:
        gone = bytearray(len(w))
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone[j : j + width] = b"\1" * width
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(left).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [None, 3])
def test_repeated_windows_are_removed(docs, pairs, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(substring, "HOT", hot)
    given = docs.filter("doc_id IS NOT NULL")
    want = plain_removal([(i, t) for i, t in pairs if i is not None], 50)
    got = Counter(tuple(r)[:4] for r in remove_repeats(given, 50).collect())
    assert got == want
    assert sum(k[2] for k in want) > 0


def test_short_windows(spark):
    rows = [(3, "a b c d e f"), (1, "x a b c y"), (2, "a b c a b c"), (4, ""), (5, "b c d"), (6, "e f a b c d")]
    got = Counter(tuple(r)[:4] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect())
    assert got == plain_removal(rows, 3)


def test_words_that_end_in_nul(spark):
    """Words that differ in trailing or repeated NULs are different words."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(w + "\0" * (i % 5 == 0) for i, w in enumerate(words))), (3, " ".join(words))]
    rows += [(4, " ".join(["\0"] * 60)), (5, " ".join(["\0\0"] * 60)), (6, "ab" * 3000 + " " + "x " * 60), (7, "ba" * 3000 + " " + "y " * 60)]
    got = Counter(tuple(r)[:4] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect())
    assert got == plain_removal(rows, 50)


def test_hashes_tell_words_apart():
    import numpy as np

    from quasirisk.llm.text import SOLID, make_hasher

    words = [b"a", b"a\0", b"a\0\0", b"\0", b"\0\0", b"b", b"\0a", b"a" * 64, b"a" * 65]
    thue = b"a"
    while len(thue) < 4096:
        thue += thue.translate(bytes.maketrans(b"ab", b"ba"))
    words += [thue, thue.translate(bytes.maketrans(b"ab", b"ba"))]
    h, starts, ends = make_hasher(SOLID)(b" ".join(words * 2))
    assert len(np.unique(h)) == len(words) and h[: len(words)].tolist() == h[len(words) :].tolist()
    assert (ends - starts).tolist() == [len(w) for w in words] * 2


def test_substring_odd_and_empty(odd, no_docs):
    assert remove_repeats(odd).count() == odd.count()
    assert remove_repeats(no_docs).count() == 0


def plain_words(text):
    raw = text.lower().encode()
    keep = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in raw)
    return keep.split()


def nearest(item, text):
    """The least edit distance of the item to any part of the text, in words."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for word in text:
        diagonal, row[0] = row[0], 0
        for j, x in enumerate(item, 1):
            diagonal, row[j] = row[j], min(diagonal + (x != word), row[j] + 1, row[j - 1] + 1)
        best = min(best, row[-1])
    return best


def test_benchmark_passages(spark, sf_dir, pairs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(12).collect()]
    carriers = [t for _, t in pairs if 200 < len(t) < 2000][: 4 * len(items)]
    rows = []
    for n, (_, text) in enumerate(items):
        w = text.split()
        edited = list(w)
        for at in range(4, len(w), 10):
            edited[at] = "changed"
        shorter = [x for j, x in enumerate(w) if j % 12 != 6]
        for k, version in enumerate((w, edited, shorter, [x.upper() + "!" for x in w])):
            base = carriers[4 * n + k].split()
            rows.append((len(rows), " ".join(base[:15] + version + base[15:])))
    rows += [(len(rows) + j, t) for j, t in enumerate([None, "", "no item here at all"] + carriers[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items + [(-1, None), (-2, ""), (-3, "...")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in find_leaks(docs, bench).collect()}
    want = {}
    for i, text in rows:
        for item_id, item in items:
            w = plain_words(item)
            e = nearest(w, plain_words(text or ""))
            if e <= 0.2 * len(w):
                want[i, item_id] = e
    assert set(got) <= set(want)
    assert all(want[k] <= got[k] for k in got)
    exact = {k for k, e in want.items() if e == 0}
    assert exact and exact <= set(got)
    assert len(got) >= 0.9 * len(want)
    kept = {r["doc_id"] for r in drop_leaks(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_short_items_are_found_at_every_position(spark, size):
    item = " ".join(["zebra", "quagga", "okapi", "gnu", "kudu"][:size])
    rows = [(n, " ".join([f"w{k}" for k in range(n)] + [item.upper() + "!"] + ["after"] * (n % 7))) for n in range(400)]
    bench = spark.createDataFrame([(1, item), (2, "some longer passage that is nowhere to be found in here at all")], "item_id long, text string")
    found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"] for r in found if r["item_id"] == 1 and r["edits"] == 0} == set(range(400))


def test_recall_holds_in_every_class(spark, sf_dir):
    """Every item of the benchmark, copied with as many random edits as are allowed."""
    import random

    from quasirisk.llm.decontaminate import EXACT, build_index, make_finder

    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if plain_words(r["text"] or "")]
    index = build_index(items, 0.2, 0.95)
    assert all(r >= 0.95 for r in index.recall.values()) and set(index.classes) <= set(index.recall)
    rng, copies = random.Random(3), []
    for text in items:
        words = text.split()
        for _ in range(len(plain_words(text)) // 5):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["edited"], [], [words[at], "added"]])
        copies.append(" ".join(["before"] * rng.randrange(9) + words + ["after"] * 9))
    want = [nearest(plain_words(t), plain_words(c)) <= 0.2 * len(plain_words(t)) for t, c in zip(items, copies, strict=True)]
    found = {(row, item) for row, item, _ in make_finder(index)(copies)}
    hit = [(n, n) in found for n, w in enumerate(want) if w]
    assert sum(hit) >= 0.9 * len(hit) > 0
    weak = build_index(items, 0.2, 1.1)
    assert set(weak.classes) == {EXACT} and weak.recall == {EXACT: 1.0}
    found = {(row, item) for row, item, _ in make_finder(weak)(copies)}
    assert all((n, n) in found for n, w in enumerate(want) if w)


def test_passages_across_the_edges_of_long_texts(spark, monkeypatch):
    from quasirisk.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SLAB", 2000)
    item = "an unusual sentence which nobody has ever written into any other text before today"
    gap = " \n" * 300
    texts = ["x" + " filler" * n + gap + gap.join(item.split()) + " filler" * 500 for n in range(0, 900, 37)]
    finder = decontaminate.make_finder(decontaminate.build_index([item], 0.2, 0.95))
    assert {row for row, _, edits in finder(texts) if edits == 0} == set(range(len(texts)))


def test_decontamination_odd_and_empty(spark, odd, no_docs):
    bench = spark.createDataFrame([(1, LONG_ITEM), (1, LONG_ITEM)], "item_id long, text string")
    assert drop_leaks(odd, bench).columns == odd.columns
    assert drop_leaks(odd, bench).filter(F.col("doc_id") == 900006).count() == 0
    assert drop_leaks(odd, bench.limit(0)).count() == odd.count()
    assert find_leaks(odd, bench.limit(0)).count() == find_leaks(no_docs, bench).count() == 0


LONG_ITEM = "lorem ipsum dolor sit amet consectetur " * 4
