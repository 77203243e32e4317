"""Candidates for minimal sample uniques by recursive refinement of equivalence classes.

A class is the set of rows that agree on some columns.  Starting from classes on one column,
each is refined by one later column at a time: rows that are alone afterwards are unique on
the columns so far, the others stay in smaller classes and are refined further.  A branch
ends where its rows are unique, so no superset of a unique set is looked at below it, and
columns only ever follow in rank order, so no set is looked at twice.

Work is shared out by class.  Classes of up to CLASS_ROWS rows are refined to the end inside
one task, many at a time as arrays; larger ones are refined by another column, until they are
small enough, unique or done.  Which classes are larger is found by counting: tasks count
the cells of their rows as arrays and send cells, not rows, and cells of the greatest size
need no more than that.  Rows are sent once for each column (or further set) that first makes
their class small, and are written nowhere in between.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quasirisk.plans.keys import key_names
from quasirisk.plans.materialize import materialize

#: Rows of a class that one task refines, and rows a task refines at a time.
CLASS_ROWS, TASK_ROWS = 50_000, 50_000
#: Rows whose cells are counted together.
COUNTED_ROWS = 200_000
#: Pairs of sets that are compared at once.
COMPARED = 1 << 22


def rank_order(base: DataFrame, m: int) -> list[int]:
    """Columns by descending number of distinct values: those that single out rows come first.

    Early columns with many values end most branches at once.  An estimate will do, since any
    order gives the same sets.
    """
    counts = base.agg(*[F.approx_count_distinct(k) for k in key_names(m)]).first()
    return sorted(range(m), key=lambda i: (-counts[i], i))


def refine(codes, weight, blocked, labels, start, depth):
    """Unique (rows, mask) below classes ``labels`` of the columns ``start`` (one mask per row).

    ``codes`` has one array of small numbers per column, ``weight`` how many equal rows a row
    stands for, ``blocked`` the columns it takes no part in; ``depth`` is the greatest size.
    """
    import numpy as np

    m = len(codes)
    widths = [int(c.max(initial=0)) + 1 for c in codes]
    found = []
    # Rows with their classes and the columns so far.
    stack = []
    for mask in np.unique(start).tolist():
        rows = np.nonzero(start == mask)[0]
        stack.append((rows, np.unique(labels[rows], return_inverse=True)[1], int(mask)))
    while stack:
        rows, label, mask = stack.pop()
        alone = np.bincount(label, weight[rows])[label] == 1
        if alone.any():
            found.append((rows[alone], mask))
        rows, label = rows[~alone], label[~alone]
        if not len(rows) or mask.bit_count() >= depth:
            continue
        for c in range(mask.bit_length(), m):
            part = blocked[rows] >> c & 1 == 0
            some = rows[part]
            if len(some):
                key = label[part] * widths[c] + codes[c][some]
                stack.append((some, np.unique(key, return_inverse=True)[1], mask | 1 << c))
    return found


def _numbers(column: pa.Array):
    """Numbers of the values of a column; NULL is number 0."""
    import numpy as np

    return np.asarray(column.dictionary_encode().indices.fill_null(-1)).astype(np.int64) + 1


def _places(codes, mask: int, classes: slice, begin: int):
    """For each row from ``begin`` on, which of the ``classes`` it agrees with inside the mask, or -1."""
    import numpy as np

    known, own = np.zeros(classes.stop - classes.start, np.int64), np.zeros(len(codes[0]) - begin, np.int64)
    for c in range(len(codes)):
        if mask >> c & 1:
            width = int(codes[c].max(initial=0)) + 1
            pairs, known = np.unique(known * width + codes[c][classes], return_inverse=True)
            wanted = own * width + codes[c][begin:]
            at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
            own = np.where((own >= 0) & (pairs[at] == wanted), at, -1)
    return own


def _chunks(batches):
    """Tables of about COUNTED_ROWS rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= COUNTED_ROWS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _slices(classes: pa.Table, begin: int) -> dict[int, slice]:
    """Where the classes of each mask are, which are listed by mask."""
    import numpy as np

    masks, first = np.unique(np.asarray(classes["mask"]), return_index=True)
    ends = [*first[1:].tolist(), classes.num_rows]
    return {k: slice(begin + a, begin + b) for k, a, b in zip(masks.tolist(), first.tolist(), ends)}


def _grown(table: pa.Table, keys: list[str], large: pa.Table | None, larger: pa.Table | None = None):
    """(mask, rows, labels) of the classes that one later column makes out of each of ``large``.

    ``large`` has (mask, keys inside it) of large classes; None stands for the class of all
    rows.  Rows in one of the classes ``larger`` are left out.  Labels are equal for rows of
    one class.
    """
    import numpy as np

    blocked = np.asarray(table["blocked"]).astype(np.int64)
    listed = [t for t in (large, larger) if t is not None]
    # Numbers of the keys of the classes and, behind them, of the rows.
    codes = [_numbers(pa.concat_arrays([x for t in (*listed, table) for x in t[k].chunks])) for k in keys]
    begin = sum(t.num_rows for t in listed)
    within = _slices(large, 0) if large is not None else {0: slice(0, 0)}
    beyond = _slices(larger, begin - larger.num_rows) if larger is not None else {}
    for mask, classes in within.items():
        place = _places(codes, mask, classes, begin) if mask else np.zeros(table.num_rows, np.int64)
        for c in range(mask.bit_length(), len(keys)):
            grown = mask | 1 << c
            part = (place >= 0) & (blocked >> c & 1 == 0)
            if grown in beyond:
                part &= _places(codes, grown, beyond[grown], begin) < 0
            rows = np.nonzero(part)[0]
            if len(rows):
                code = codes[c][begin:][rows]
                yield grown, rows, place[rows] * (int(code.max()) + 1) + code


def _key_columns(table: pa.Table, keys: list[str], at, shown) -> list[pa.Array]:
    """Keys of some rows, as far as ``shown``; the others NULL."""
    return [
        table[k].take(at).combine_chunks() if shown(c) else pa.nulls(len(at), table.schema.field(k).type)
        for c, k in enumerate(keys)
    ]


def _cells(ranked: DataFrame, keys: list[str], large) -> DataFrame:
    """(mask, keys inside it, n, size, rid): the classes next to ``large`` with their weight, number of rows and one row."""

    def work(batches):
        import numpy as np

        for table in _chunks(batches):
            n, rid = np.asarray(table["n"]).astype(np.int64), table["rid"].combine_chunks()
            for mask, rows, labels in _grown(table, keys, large.value):
                if labels.max() > 4 * len(rows):
                    labels = np.unique(labels, return_inverse=True)[1]
                size = np.bincount(labels)
                cell = np.nonzero(size)[0]
                # Whole numbers below 2**53.
                weight = np.bincount(labels, n[rows])[cell].astype(np.int64)
                first = np.zeros(len(size), np.int64)
                first[labels] = rows
                at = pa.array(first[cell])
                cells = [pa.array(np.full(len(cell), mask)), *_key_columns(table, keys, at, lambda c: mask >> c & 1)]
                cells += [pa.array(weight), pa.array(size[cell]), rid.take(at)]
                yield pa.RecordBatch.from_arrays(cells, names=["mask", *keys, "n", "size", "rid"])

    fields = ranked.schema
    schema = T.StructType([T.StructField("mask", T.LongType()), *[fields[k] for k in keys], T.StructField("n", T.LongType()),
                           T.StructField("size", T.LongType()), fields["rid"]])
    sums = [F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("rid").alias("rid")]
    return ranked.mapInArrow(work, schema).groupBy("mask", *keys).agg(*sums)


def _dealt(ranked: DataFrame, keys: list[str], large, larger) -> DataFrame:
    """Rows of the classes next to ``large`` that are not among ``larger``, once for each such class.

    Keys that come before the last one of the mask and are not inside it are no longer needed.
    """

    def work(batches):
        import numpy as np

        for table in _chunks(batches):
            for mask, rows, _ in _grown(table, keys, large.value, larger.value):
                for begin in range(0, len(rows), TASK_ROWS):
                    at = pa.array(rows[begin : begin + TASK_ROWS])
                    shown = lambda c: mask >> c & 1 or c >= mask.bit_length()  # noqa: E731, B023
                    columns = [pa.array(np.full(len(at), mask)), *_key_columns(table, keys, at, shown)]
                    columns += [table[c].take(at).combine_chunks() for c in ("n", "rid", "blocked")]
                    yield pa.RecordBatch.from_arrays(columns, names=["mask", *keys, "n", "rid", "blocked"])

    return ranked.mapInArrow(work, T.StructType([T.StructField("mask", T.LongType()), *ranked.schema.fields]))


def _refined(rows: DataFrame, m: int, depth: int) -> DataFrame:
    """Candidates of whole classes; rows of a class lie next to each other in one task."""
    keys = key_names(m)
    # A hash of the class: classes that share one are told apart in the task.
    inside = [F.expr(f"IF(mask & {1 << i}L <> 0, {k}, NULL)") for i, k in enumerate(keys)]
    hashed = rows.withColumn("h", F.xxhash64("mask", *inside))
    listed = hashed.repartition("h").sortWithinPartitions("h", "mask").select("h", "mask", "rid", "n", "blocked", *keys)

    def work(batches):
        import numpy as np

        def flush(tables):
            table = pa.Table.from_batches(tables).combine_chunks()
            codes = []
            for k in keys:
                codes.append(_numbers(table.column(k).combine_chunks()))
            start = np.asarray(table.column("mask")).astype(np.int64)
            # Classes of one mask are told apart by their keys inside it.
            labels = np.zeros(len(start), np.int64)
            for mask in np.unique(start).tolist():
                of = np.nonzero(start == mask)[0]
                label = np.zeros(len(of), np.int64)
                for c in range(m):
                    if mask >> c & 1:
                        label = np.unique(label * (int(codes[c].max()) + 1) + codes[c][of], return_inverse=True)[1]
                labels[of] = label
            rid = table.column("rid").combine_chunks()
            n, blocked = (np.asarray(table.column(c)).astype(np.int64) for c in ("n", "blocked"))
            for at, mask in refine(codes, n, blocked, labels, start, depth):
                yield pa.RecordBatch.from_arrays([rid.take(pa.array(at)), pa.array(np.full(len(at), mask))], names=["rid", "mask"])

        held, size = [], 0
        for batch in batches:
            # Cut only where a class ends.
            h = np.asarray(batch.column("h"))
            mask = np.asarray(batch.column("mask"))
            edges = np.nonzero((h[1:] != h[:-1]) | (mask[1:] != mask[:-1]))[0] + 1
            rest = batch.select(["mask", "rid", "n", "blocked", *keys])
            same = held and last == (int(h[0]), int(mask[0]))
            if size + len(h) > TASK_ROWS and held:
                cut = 0 if not same else (int(edges[0]) if len(edges) else len(h))
                if cut < len(h):
                    yield from flush([*held, rest.slice(0, cut)])
                    held, size, rest = [], 0, rest.slice(cut)
            held.append(rest)
            size += rest.num_rows
            last = int(h[-1]), int(mask[-1])
        if held:
            yield from flush(held)

    schema = rows.select("rid", "mask").schema
    return listed.mapInArrow(work, schema)


def unique_sets(base: DataFrame, m: int, blocked: Column, depth: int) -> DataFrame:
    """(rid, mask): sets of at most ``depth`` columns on which a record is alone.

    Each is unique while the set without its last column in rank order is not, so every
    minimal set is among them.  ``base`` has k0.., n and rid; ``blocked`` is a bitmask of
    columns a row takes no part in.  Masks are of the columns as given.  ``base`` is read
    several times, so it should be stored.
    """
    order = rank_order(base, m)
    keys = key_names(m)
    moved = F.lit(0).cast("long")
    for place, c in enumerate(order):
        moved = moved.bitwiseOR(F.shiftleft(F.shiftright(blocked, c).bitwiseAND(F.lit(1).cast("long")), place))
    ranked = base.select(*[F.col(keys[c]).alias(f"c{place}") for place, c in enumerate(order)], "n", "rid", moved.alias("blocked"))
    ranked = ranked.toDF(*keys, "n", "rid", "blocked")
    spark = base.sparkSession
    large = spark.sparkContext.broadcast(None)
    found = []
    for size in range(1, depth + 1):
        cells = _cells(ranked, keys, large)
        if size == depth:
            found.append(cells.where("n = 1").select("rid", "mask"))
            break
        # Fewer than rows / CLASS_ROWS for each set that is looked at.
        listed = cells.where(F.col("size") > CLASS_ROWS).select("mask", *keys).toArrow()
        larger = spark.sparkContext.broadcast(listed.sort_by("mask") if listed.num_rows else None)
        found.append(_refined(_dealt(ranked, keys, large, larger), m, depth))
        if not listed.num_rows:
            break
        large = larger
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.union(more)
    back = F.lit(0).cast("long")
    for place, c in enumerate(order):
        bit = F.shiftright(F.col("mask"), place).bitwiseAND(F.lit(1).cast("long"))
        back = back.bitwiseOR(F.shiftleft(bit, c))
    return all_found.select("rid", back.alias("mask"))


def minimal_masks(masks):
    """Those of an array of masks that contain no other one, smallest first."""
    import numpy as np

    masks = np.unique(masks)
    sizes = np.bitwise_count(masks)
    masks = masks[np.lexsort((masks, sizes))]
    kept = np.zeros(0, np.int64)
    for size in np.unique(sizes).tolist():
        level = masks[np.bitwise_count(masks) == size]
        covered = np.zeros(len(level), bool)
        step = max(1, COMPARED // max(1, len(level)))
        for at in range(0, len(kept), step):
            below = kept[at : at + step]
            covered |= ((level[:, None] & below) == below).any(axis=1)
        kept = np.concatenate((kept, level[~covered]))
    return kept


def minimal_sets(base: DataFrame, m: int, blocked: Column, depth: int) -> DataFrame:
    """(rid, msus): the minimal sets of each record that has any, smallest first."""
    found = unique_sets(base, m, blocked, depth).groupBy("rid").agg(F.collect_list("mask").alias("msus"))

    def work(batches):
        import numpy as np

        for batch in batches:
            lists = batch.column(1)
            masks = np.asarray(lists.flatten()).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            sizes = np.bitwise_count(masks)
            order = np.lexsort((masks, sizes, owner))
            masks, owner, sizes = masks[order], owner[order], sizes[order]
            kept = np.append(True, (masks[1:] != masks[:-1]) | (owner[1:] != owner[:-1]))[: len(masks)]
            # Sets of one size do not contain each other.
            bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
            for i in np.nonzero(sizes[bounds[:-1]] != sizes[bounds[1:] - 1])[0]:
                part = slice(bounds[i], bounds[i + 1])
                kept[part] &= np.isin(masks[part], minimal_masks(masks[part]))
            ends = pa.array(np.append(0, np.cumsum(np.bincount(owner[kept], minlength=len(lists)))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(masks[kept]))], names=["rid", "msus"])

    return found.mapInArrow(work, found.schema)


def _all_supersets(m: int, masks, free: int):
    """Which of the 2**m sets contain one of ``masks`` and else only columns of ``free``."""
    import numpy as np

    held = np.zeros(1 << m, bool)
    held[masks] = True
    for i in range(m):
        if free >> i & 1:
            halves = held.reshape(-1, 2, 1 << i)
            halves[:, 1] |= halves[:, 0]
    return held


def uniques_by_set(base: DataFrame, m: int, drop_nulls: bool) -> DataFrame:
    """(mask, uniques): the number of records alone on each set of columns, for all sets that have any.

    A record is alone on a set exactly if the set contains one of its minimal sets, so the
    counts are sums over records of the up-sets of their minimal sets: a subset-sum (zeta)
    transform with OR for each record, added up as arrays of 2**m numbers per task.  With
    ``drop_nulls``, a record takes part only in sets without its NULL columns, so its up-set
    stays inside the others.  For m up to DENSE_COLUMNS.
    """
    from quasirisk.plans.keys import bits_where

    none = F.lit(0).cast("long")
    blocked = bits_where([F.col(k).isNull() for k in key_names(m)]) if drop_nulls else none
    numbered = materialize(base.withColumn("rid", F.monotonically_increasing_id()))
    minimal = minimal_sets(numbered, m, blocked, m)
    own = numbered.where("n = 1").select("rid", blocked.alias("blocked"))
    # Records with the same minimal sets and NULL columns count together.
    kinds = minimal.join(own, "rid").groupBy("msus", "blocked").agg(F.count(F.lit(1)).alias("records"))

    def work(batches):
        import numpy as np

        counts = np.zeros(1 << m, np.int64)
        for batch in batches:
            for masks, missing, records in zip(*(batch.column(i) for i in range(3)), strict=True):
                counts += records.as_py() * _all_supersets(m, np.asarray(masks.values), ~missing.as_py())
        some = np.nonzero(counts)[0]
        for at in range(0, len(some), 100_000):
            part = some[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["mask", "uniques"])

    return kinds.mapInArrow(work, "mask long, uniques long").groupBy("mask").agg(F.sum("uniques").alias("uniques"))


#: Columns up to which a task may hold a number for every set of them: 8 MB at 20.
DENSE_COLUMNS = 20
