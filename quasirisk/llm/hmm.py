"""Language model: a hidden Markov model over word classes, trained on the whole corpus.

The most frequent tokens are classes of their own; all others fall into classes by their
last bytes.  States emit classes, and a class emits its tokens in proportion to their counts,
with room for unknown ones by the share of tokens seen once; that room is shared out by a
spelling model over all byte strings of the class.  So the chances of all tokens add up to
one, and every text has an exact likelihood: the scaled forward recursion over its classes,
times its tokens' shares.

Baum-Welch runs over whole texts.  Long ones are cut into segments; products of their steps
carry the forward and backward chances over the cuts exactly, so that all segments can then be
worked on side by side.  Counts are added up in the tasks and then across them; the model has
a fixed size.  Only counts of tokens grow with the corpus; those stay distributed, and rare tokens meet
their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.llm.store import Store, map_batches, summed_parts
from quasirisk.llm.text import SOLID, byte_words, columns, fold, make_hasher, slabs

#: Hidden states, tokens with a class of their own, and classes of all other tokens.
STATES, OWN, SHARED = 8, 16_384, 1024
CLASSES = OWN + SHARED
#: Tokens whose counts are broadcast at most; the rest is joined.
BROADCAST_TOKENS = 262_144
#: Tokens of a training segment; segments or texts worked on together at most, and tokens of such
#: a group; matrices worked on together; steps of a block that scoring has at hand.
SEGMENT, WIDTH, AREA, MATRICES, BLOCK = 1024, 1024, 1 << 18, 256, 1024
#: Chances are scaled at every so many steps.  No emission of a trained model over N tokens lies
#: below about 0.1 * PRIOR / N ** 2, so that none becomes zero in between.
SCALED = 8
#: Rows of the spelling model for the two bytes after a byte, its mark for either end of a token,
#: and the weight of the bytes' overall chances in each row.
CONTEXTS, EDGE, SPELLING_PRIOR = 4096, 256, 2.0
#: Weight of the overall class distribution in each state's emissions.
PRIOR = 200.0
COUNTER_TOKENS = 400_000
SLAB = 1 << 20
#: The end of a text is token number 0 of the classes.
END = 0


def shared_class(token: bytes) -> int:
    return OWN + zlib.crc32(token[-3:]) % SHARED


def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, shared, c) over all texts; counted in the tasks before the shuffle."""

    def run(batches):
        from collections import Counter

        counts: Counter = Counter()

        def flush():
            tokens = [t.decode("utf-8") for t in counts]
            shared = [shared_class(t) for t in counts]
            out = pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.string()), pa.array(shared, pa.int32()), pa.array(list(counts.values()), pa.int64())],
                names=["token", "shared", "c"],
            )
            counts.clear()
            return out

        for batch in batches:
            for text in columns(batch, "text")[0]:
                counts.update(byte_words(text, lower=True))
                if len(counts) > COUNTER_TOKENS:
                    yield flush()
        if counts:
            yield flush()

    partial = texts.select("text").mapInArrow(run, "token string, shared int, c long")
    return partial.groupBy("token", "shared").agg(F.sum("c").alias("c"))


def context(farther, nearer):
    """Row of a chain's table for the two bytes after a byte; EDGE stands for the end of the token."""
    import numpy as np

    mixed = (np.asarray(farther, np.uint64) * np.uint64(257) + np.asarray(nearer, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(np.asarray(nearer) == EDGE, CONTEXTS, (mixed >> np.uint64(52)).astype(np.int64))


def chain(tokens: list[bytes]):
    """(row, symbol) of every step that spells the tokens from their last byte to their first, and where tokens start.

    A step's symbol is a byte, or EDGE after the first byte of the token.
    """
    import numpy as np

    raw = np.frombuffer(b"".join(b" " + t for t in tokens) + b"  ", np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in tokens])
    starts = np.cumsum(sizes) - sizes
    here = raw.copy()
    here[starts] = EDGE
    here[-2:] = EDGE
    one = here[1:-1]
    two = np.where(one == EDGE, EDGE, here[2:])
    return context(two, one), here[:-2], starts


@dataclass
class Spelling:
    """Chances of tokens by their bytes, spelled backwards: each byte given the two after it.

    ``table`` has a row per context and a column per byte and one for the end of the
    spelling; every row adds up to 1 and can end, so the chances of all strings of the bytes
    of lower-cased words add up to 1.
    """

    table: object

    @classmethod
    def learnt(cls, keys, counts, usable):
        """From counts of (row, symbol), keyed as row * 257 + symbol, smoothed by the counts of the symbols alone."""
        import numpy as np

        seen = np.zeros((CONTEXTS + 1) * 257)
        np.add.at(seen, keys, counts)
        seen = seen.reshape(-1, 257)
        allowed = np.append(usable, 1.0)
        alone = (seen[:CONTEXTS].sum(0) + 1) * allowed
        table = seen * allowed + SPELLING_PRIOR * alone / alone.sum()
        table[CONTEXTS, EDGE] = 0.0  # no token is empty
        return cls(table / table.sum(1, keepdims=True))

    def log10(self, tokens: list[bytes]):
        """log10 chances of the tokens."""
        import numpy as np

        if not tokens:
            return np.zeros(0)
        rows, symbols, starts = chain(tokens)
        return np.add.reduceat(np.log10(self.table[rows, symbols]), starts)

    def of_classes(self):
        """Chance of all tokens of each shared class: a sum over all endings of up to three bytes."""
        import numpy as np

        used = np.nonzero(self.table[CONTEXTS])[0]
        last = self.table[CONTEXTS, used]
        # The table of CRC-32, out of the checksums of single bytes.
        step = np.array([zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], np.uint32)
        follow = lambda c, byte: step[(c ^ byte) & 255] ^ (c >> 8)
        byte = used.astype(np.uint32)
        fresh = np.uint32(0xFFFFFFFF)
        out = np.zeros(SHARED)

        def add(state, chance):
            out[:] += np.bincount((state.ravel() ^ fresh) % SHARED, chance.ravel(), SHARED)

        alone = self.table[context(np.full(len(used), EDGE), used)]  # given the last byte
        add(follow(fresh, byte), last * alone[:, EDGE])
        for y in used:
            rows = self.table[context(used, np.full(len(used), y))]  # given y and the last byte
            pair = last * alone[:, y]
            add(follow(follow(fresh, np.uint32(y)), byte), pair * rows[:, EDGE])
            three = follow(follow(follow(fresh, byte), np.uint32(y))[:, None], byte)
            add(three, (pair[:, None] * rows[:, used]).T)
        return out


def learn_spelling(counts: DataFrame) -> Spelling:
    """From the stored counts, every kind of token once: unknown tokens are kinds, too.

    A task sends the steps it met; there are at most (CONTEXTS + 1) * 257 of them.
    """
    import numpy as np

    def run(batches):
        held = np.zeros((CONTEXTS + 1) * 257, np.int64)
        for batch in batches:
            if batch.num_rows:
                rows, symbols, _ = chain(batch.column(0).cast(pa.binary()).to_pylist())
                held += np.bincount(rows * 257 + symbols, minlength=len(held))
        met = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(held[met])], names=["step", "n"])

    steps = counts.select("token").mapInArrow(run, "step int, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    usable = np.zeros(256)
    usable[list(SOLID)] = 1.0
    usable[ord("A") : ord("Z") + 1] = 0.0
    return Spelling.learnt(steps["step"].to_numpy(), steps["n"].to_numpy(), usable)


@dataclass
class Vocabulary:
    """Counts of the broadcast tokens and of the shared classes; of bounded size."""

    hashes: object  # sorted hashes of the broadcast tokens
    counts: object  # their counts
    classes: object  # their classes
    total: int  # N
    distinct: int  # V
    texts: int  # training texts, the count of the end token
    class_counts: object  # tokens of each class
    class_once: object  # of those, tokens that were seen once
    spelling: Spelling
    spelled: object  # log10 chances of the broadcast tokens by their spelling
    room: object  # chance by spelling of all tokens of each class that have no class of their own

    def base(self, counts):
        import numpy as np

        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def unknown(self):
        """Chance that a token of each class is an unknown one."""
        import numpy as np

        n, once = self.class_counts, self.class_once
        return np.where(n > 0, (once + 0.5) / (n + 1.0), 1.0)

    def prior(self):
        """Chances of the classes: END, the own classes in use, and all shared ones."""
        import numpy as np

        n = self.class_counts + 0.1 * ((self.class_counts > 0) | (np.arange(CLASSES) >= OWN) | (np.arange(CLASSES) == END))
        return n / n.sum()

    def log10_shares(self):
        """log10 chance of each broadcast token within its class."""
        import numpy as np

        own = self.classes < OWN
        unknown = self.unknown()[self.classes]
        n = np.maximum(self.class_counts[self.classes], 1)
        chance = (1 - unknown) * self.counts / n + unknown * 10.0 ** (self.spelled - np.log10(self.room[self.classes]))
        return np.where(own, 0.0, np.log10(np.where(own, 1.0, chance)))


def build_vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From the stored counts: tokens above a count that leaves few enough of them."""
    import numpy as np

    bucket = F.floor(F.log2("c") * 8)
    sizes = counts.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 8 x 64 rows
    cut, held = None, 0
    for row in sorted(sizes, key=lambda r: -r["bucket"]):
        held += row["n"]
        if held > BROADCAST_TOKENS:
            cut = row["bucket"]
            break
    chosen = counts if cut is None else counts.filter(bucket > cut)
    frequent = sorted(chosen.collect(), key=lambda r: (-r["c"], r["token"]))
    once = F.sum(F.when(F.col("c") == 1, 1).otherwise(0))
    shared = counts.groupBy("shared").agg(F.sum("c").alias("n"), once.alias("once"), F.count(F.lit(1)).alias("kinds")).collect()
    class_counts, class_once = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in shared:
        class_counts[row["shared"]], class_once[row["shared"]] = row["n"], row["once"]
    total = int(class_counts.sum()) + texts
    class_counts[END] = texts
    classes = np.array([r["shared"] for r in frequent], np.uint16)
    for i, row in enumerate(frequent[: OWN - 1]):
        classes[i] = i + 1
        class_counts[i + 1] = row["c"]
        class_counts[row["shared"]] -= row["c"]
        class_once[row["shared"]] -= row["c"] == 1
    spelling = learn_spelling(counts)
    hashes, _, _ = make_hasher(SOLID)("\n".join(r["token"] for r in frequent).encode())
    spelled = spelling.log10([r["token"].encode() for r in frequent])
    room = np.ones(CLASSES)
    room[OWN:] = whole = spelling.of_classes()
    for row, chance in zip(frequent[: OWN - 1], 10.0 ** spelled[: OWN - 1]):
        room[row["shared"]] -= chance
    # Never nothing: longer tokens of the class are always left.
    room[OWN:] = np.maximum(room[OWN:], whole * 1e-12)
    order = np.argsort(hashes)
    values = np.array([r["c"] for r in frequent], np.int64)
    distinct = sum(r["kinds"] for r in shared) + (texts > 0)
    tables = (hashes[order], values[order], classes[order])
    return Vocabulary(*tables, total, distinct, texts, class_counts, class_once, spelling, spelled[order], room)


def encode(docs: DataFrame, shared) -> DataFrame:
    """Classes of each text, sums over its broadcast tokens, and its rare tokens."""
    schema = "doc_id long, n_tokens long, n_known long, base double, inside double, classes binary, rare array<struct<token:string,shared:int,spelled:double>>"

    def make():
        import numpy as np

        vocabulary = shared.value
        hashes = make_hasher(SOLID)
        base = vocabulary.base(vocabulary.counts)
        log_share = vocabulary.log10_shares()
        end_base = float(vocabulary.base(np.array(vocabulary.texts)))

        def of_slab(texts):
            raws = [(t or "").encode("utf-8", "replace").lower() for t in texts]
            raw = b"\n".join(raws)
            words, starts, ends = hashes(raw)
            bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
            unique, inverse = np.unique(words, return_inverse=True)
            at = np.minimum(np.searchsorted(vocabulary.hashes, unique), max(0, len(vocabulary.hashes) - 1))
            met = vocabulary.hashes[at] == unique if len(vocabulary.hashes) else np.zeros(len(unique), bool)
            frequent, at = met[inverse], at[inverse]
            classes = np.zeros(len(words), np.uint16)
            classes[frequent] = vocabulary.classes[at[frequent]]
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            sums = [np.bincount(doc[frequent], w[at[frequent]], len(texts)) for w in (base, log_share)]
            many = np.bincount(doc[frequent], minlength=len(texts))
            rare: list[list[dict]] = [[] for _ in texts]
            others = np.nonzero(~frequent)[0]
            tokens = [raw[starts[i] : ends[i]] for i in others.tolist()]
            for i, token, chance in zip(others.tolist(), tokens, vocabulary.spelling.log10(tokens).tolist()):
                classes[i] = shared_class(token)
                rare[doc[i]].append({"token": token.decode("utf-8"), "shared": int(classes[i]), "spelled": chance})
            for i in range(len(texts)):
                line = np.append(classes[bounds[i] : bounds[i + 1]], np.uint16(END))
                yield len(line), int(many[i]) + (vocabulary.texts > 0), sums[0][i] + end_base, sums[1][i], line.astype("<u2").tobytes(), rare[i]

        def each(batch):
            ids, texts = columns(batch, "doc_id", "text")
            out = [row for a, b in slabs(texts, SLAB) for row in of_slab(texts[a:b])]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("token", pa.string()), ("shared", pa.int32()), ("spelled", pa.float64())])))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            names = ["doc_id", "n_tokens", "n_known", "base", "inside", "classes", "rare"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *cols], names=names)

        return each

    return map_batches(docs.select("doc_id", "text"), schema, make)


@dataclass
class Model:
    start: object  # chance of each first state
    move: object  # row: from, column: to
    emit: object  # row: class, column: state

    @cached_property
    def rows(self):
        """Emissions and moves with a row per state that is emitting or moved to."""
        import numpy as np

        return np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T)

    def chances(self, table, out=None):
        """Emissions by time, state and sequence, state by state out of a row that stays in the cache."""
        import numpy as np

        out = np.empty((len(table), len(self.start), table.shape[1])) if out is None else out
        for s, row in enumerate(self.rows[0]):
            out[:, s] = row.take(table)
        return out


def first_model(prior, seed: int = 1) -> Model:
    """States that mostly stay, and emissions near the overall ones."""
    import numpy as np

    rng = np.random.default_rng(seed)
    emit = prior[:, None] * rng.gamma(2.0, 0.5, (len(prior), STATES))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def padded(sequences):
    """(classes by time and sequence, lengths, sequences live at each time) of sequences given longest first."""
    import numpy as np

    lengths = np.array([len(s) for s in sequences])
    table = np.zeros((lengths[0], len(sequences)), np.intp)
    for i, s in enumerate(sequences):
        table[: len(s), i] = s
    return table, lengths, np.searchsorted(-lengths, -np.arange(lengths[0]), "left").tolist()


def groups_of(lengths):
    """Index ranges of at most WIDTH sequences, given longest first, and of at most AREA classes or one sequence."""
    at = 0
    while at < len(lengths):
        end = min(len(lengths), at + min(WIDTH, max(1, AREA // lengths[at])))
        yield at, end
        at = end


@dataclass
class Piece:
    """A segment of a text with what is known at its ends."""

    classes: object
    before: object = None  # forward chances of the states at the end of the segment before; None: the text starts here
    after: object = None  # backward factors of the states at the end of the segment; None: the text ends here


def expected_counts(model: Model, pieces: list[Piece], sums, space=None) -> None:
    """Add the Baum-Welch counts of one group of segments to ``sums``.

    Chances lie by time, state and segment, in the two rows of ``space``.  They are scaled at
    every SCALED-th step only; the backward chances of a segment start so that at its end
    their products with the forward ones add up to 1.
    """
    import numpy as np

    pieces = sorted(pieces, key=lambda p: len(p.classes), reverse=True)
    table, lengths, live = padded([p.classes for p in pieces])
    steps, n = table.shape
    states = len(model.start)
    space = np.empty((2, steps * states * n)) if space is None else space
    alpha, emit = space[:, : steps * states * n].reshape(2, steps, states, n)
    model.chances(table, emit)
    forth, back = model.rows[1], model.move
    inner = np.array([p.before is not None for p in pieces])
    before = np.array([p.before if p.before is not None else np.zeros(states) for p in pieces]).T
    after = np.array([p.after if p.after is not None else np.ones(states) for p in pieces]).T
    room = np.empty((states, n))
    for t, k in enumerate(live):
        now, chance, a = alpha[t, :, :k], emit[t, :, :k], room[:, :k]
        if t:
            np.matmul(forth, alpha[t - 1, :, :k], out=a)
        else:
            a[:] = np.where(inner, forth @ before, model.start[:, None])
        np.multiply(a, chance, out=now)
        if t % SCALED == 0:
            scale = now.sum(0)
            now /= scale
            chance /= scale
        if k < n:
            alpha[t, :, k:] = 0.0
    end = alpha[lengths - 1, :, np.arange(n)].T
    beta = after / (end * after).sum(0)
    room[:] = beta  # both hold the ends of segments not yet reached
    moves = np.zeros((states, states))
    for t in range(steps - 1, -1, -1):
        k = live[t]
        weights, chance, b = alpha[t, :, :k], emit[t, :, :k], beta[:, :k]
        weights *= b
        chance *= b
        # Over the cut before a segment there is a step, too; before a text there is none.
        moves += (alpha[t - 1, :, :k] if t else before) @ chance.T
        np.matmul(back, chance, out=room[:, :k])
        beta, room = room, beta
    sums["move"] += model.move * moves
    sums["start"] += alpha[0][:, ~inner].sum(1)
    flat = table.ravel()
    for s in range(states):
        sums["emit"][:, s] += np.bincount(flat, alpha[:, s].ravel(), len(model.emit))


def products(model: Model, lines: list) -> list:
    """For each line of classes the matrix that takes forward chances before it to those at its end, scaled."""
    import numpy as np

    size = len(model.start)
    forth = model.rows[1]
    out: list = [None] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    for at in range(0, len(order), MATRICES):
        group = order[at : at + MATRICES]
        table, _, live = padded([lines[i] for i in group])
        emit = model.chances(table)
        # By last state, first state and line; ended lines are taken out.
        made = np.repeat(np.eye(size)[:, :, None], len(group), 2)
        room = np.empty_like(made)
        for t, k in enumerate([*live, 0]):
            if k < made.shape[2]:
                for i, matrix in zip(group[k:], made[:, :, k:].transpose(2, 1, 0)):
                    out[i] = matrix / matrix.sum()
                group, made, room = group[:k], made[:, :, :k].copy(), np.empty((size, size, k))
            if k:
                np.matmul(forth, made.reshape(size, -1), out=room.reshape(size, -1))
                np.multiply(room, emit[t, :, None, :k], out=made)
                if t % SCALED == 0:
                    made /= made.sum((0, 1))
    return out


def pieces_of(model: Model, lines: list) -> list[Piece]:
    """Segments of whole texts, with the exact chances at their ends."""
    import numpy as np

    cut = [[line[i : i + SEGMENT] for i in range(0, len(line), SEGMENT)] for line in lines]
    long = [parts for parts in cut if len(parts) > 1]
    out = [Piece(parts[0]) for parts in cut if len(parts) == 1]
    matrices = iter(products(model, [segment for parts in long for segment in parts[1:]]))
    # The first step of a text has no step before it.
    firsts = products(model, [parts[0][1:] for parts in long])
    for parts, first in zip(long, firsts):
        steps = [next(matrices) for _ in parts[1:]]
        ends = [(model.start * model.emit[parts[0][0]]) @ first]
        ends[0] /= ends[0].sum()
        for matrix in steps:
            end = ends[-1] @ matrix
            ends.append(end / end.sum())
        pieces = [Piece(segment, before) for segment, before in zip(parts, [None, *ends])]
        after = np.ones(len(model.start))
        for i in range(len(steps) - 1, -1, -1):
            after = steps[i] @ after
            after /= ends[i] @ after
            pieces[i].after = after
        out.extend(pieces)
    return out


def empty_sums(classes: int) -> dict:
    import numpy as np

    return {"start": np.zeros(STATES), "move": np.zeros((STATES, STATES)), "emit": np.zeros((classes, STATES))}


def next_model(sums: dict, prior) -> Model:
    """New parameters, each smoothed so that no state or class becomes impossible."""
    start = sums["start"] + 1.0
    move = sums["move"] + 1.0
    emit = sums["emit"] + PRIOR * prior[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def add_groups(model: Model, raws, sums) -> None:
    """Expected counts of whole texts, some segments of similar length at a time."""
    import numpy as np

    pieces = pieces_of(model, [np.frombuffer(raw, "<u2").astype(np.int64) for raw in raws])
    pieces.sort(key=lambda p: -len(p.classes))
    groups = list(groups_of([len(p.classes) for p in pieces]))
    areas = [len(pieces[begin].classes) * (end - begin) for begin, end in groups]
    space = np.empty((2, max(areas, default=0) * len(model.start)))
    for begin, end in groups:
        expected_counts(model, pieces[begin:end], sums, space)


def train(encoded: DataFrame, prior, rounds: int) -> Model:
    """Baum-Welch: every round, from the first on, runs over all whole texts."""
    import numpy as np

    spark = encoded.sparkSession
    size = len(prior)
    model = first_model(prior)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            sums = empty_sums(size)
            for batch in batches:
                add_groups(shared.value, columns(batch, "classes")[0], sums)
            rest = np.concatenate((sums["start"], sums["move"].ravel()))
            values = [*np.ascontiguousarray(sums["emit"].T), rest]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([v.tolist() for v in values])], names=["part", "values"])

        parts = summed_parts(encoded.select("classes").mapInArrow(run, "part int, values array<double>"))
        if not parts:
            break
        rest = parts[STATES]
        sums = {"start": rest[:STATES], "move": rest[STATES:].reshape(STATES, STATES), "emit": np.stack([parts[s] for s in range(STATES)], 1)}
        model = next_model(sums, prior)
        shared.unpersist()
    return model


def log10_likelihoods(model: Model, raws) -> list[float]:
    """log10 probability of each whole class sequence, by the scaled forward recursion."""
    import numpy as np

    emit_of, forth = model.rows
    out = np.zeros(len(raws))
    order = sorted(range(len(raws)), key=lambda i: -len(raws[i]))
    for at in range(0, len(order), WIDTH):
        group = order[at : at + WIDTH]
        lines = [np.frombuffer(raws[i], "<u2") for i in group]
        longest = len(lines[0])
        alpha, room, total = np.zeros((len(model.start), len(group))), np.empty((len(model.start), len(group))), np.zeros(len(group))
        for begin in range(0, longest, BLOCK):
            table, _, live = padded([part for x in lines if len(part := x[begin : begin + BLOCK])])
            for t, k in enumerate(live, begin):
                now, step = alpha[:, :k], room[:, :k]
                if t:
                    np.matmul(forth, now, out=step)
                else:
                    step[:] = model.start[:, None]
                np.multiply(step, emit_of.take(table[t - begin, :k], 1), out=now)
                if t % SCALED == 0:
                    scale = now.sum(0)
                    now /= scale
                    total[:k] += np.log10(scale)
        # What was not scaled since; chances of ended texts stay as they are.
        out[group] = total + np.log10(alpha.sum(0))
    return out.tolist()


def score_texts(docs: DataFrame, folds: int = 10, rounds: int = 6) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row.

    Learns from the rows whose crc32(doc_id as text) is no multiple of ``folds``.  Tokens are
    the words, A-Z in lower case, and one end.  NULL and empty texts are the end alone; rows
    with equal ids are independent.  Without training texts all tokens are unknown.
    """
    spark = docs.sparkSession
    store = Store(spark, "hmm")
    taught = docs.filter(fold(F.col("doc_id"), folds) != 0)
    counts = store.keep(count_tokens(taught), "counts")
    vocabulary = build_vocabulary(counts, taught.count())
    shared = spark.sparkContext.broadcast(vocabulary)
    encoded = store.keep(encode(docs, shared).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = spark.sparkContext.broadcast(train(encoded.filter(fold(F.col("doc_id"), folds) != 0), vocabulary.prior(), rounds))

    def make():
        def each(batch):
            rows, raws = columns(batch, "row", "classes")
            values = log10_likelihoods(model.value, raws)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(values, pa.float64())], names=["row", "forward"])

        return each

    rare = encoded.select("row", F.inline("rare")).join(counts.drop("shared"), "token", "left")
    # One row per shared class.
    sizes = [
        (i, float(vocabulary.class_counts[i]), float(u), math.log10(vocabulary.room[i])) for i, u in enumerate(vocabulary.unknown()) if i >= OWN
    ]
    rare = rare.join(F.broadcast(spark.createDataFrame(sizes, "shared int, of_class double, unknown double, room double")), "shared")
    count = F.coalesce("c", F.lit(0))
    below = vocabulary.total + 0.1 * (vocabulary.distinct + 1)
    by_spelling = F.col("spelled") - F.col("room")
    seen = (1 - F.col("unknown")) * F.col("c") / F.col("of_class") + F.col("unknown") * F.pow(F.lit(10.0), by_spelling)
    # The power of a long unknown token would be zero; its logarithm is not.
    log_share = F.when(F.col("c") > 0, F.log10(seen)).otherwise(F.log10("unknown") + by_spelling)
    rare = rare.groupBy("row").agg(
        F.sum((count > 0).cast("long")).alias("known_"), F.sum(F.log10((count + 0.1) / below)).alias("base_"),
        F.sum(log_share).alias("inside_"),
    )
    forward = map_batches(encoded.select("row", "classes"), "row long, forward double", make)
    joined = encoded.drop("classes", "rare").join(forward, "row").join(rare, "row", "left")
    nothing = F.lit(0.0)
    return joined.select(
        "doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("known_", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_", nothing)).alias("base_score"),
        (F.col("forward") + F.col("inside") + F.coalesce("inside_", nothing)).alias("score"),
    )
