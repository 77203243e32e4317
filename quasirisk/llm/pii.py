"""Personal data: fixed patterns, and identifiers that their contexts give away.

The matches of the fixed patterns are seeds.  The words around them are lexical patterns;
each text position that holds an identifier-like token ties a pattern to an instance.  On
that graph Spark scores patterns by the share of trusted instances they hold, and instances
by the patterns they stand in, over some rounds.  Instances that trusted patterns agree on
become spans of the patterns' kind.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quasirisk.llm.store import Store, map_batches
from quasirisk.llm.text import columns, spans_digest, spans_text

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits whose first digit starts no match has none at its later digits either.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

#: Digits of a token that may be an identifier, and characters looked at on either side.
MIN_DIGITS, REACH = 4, 80
_TRIM = ".,;:!?()[]{}<>\"'|#*&%$"


def _luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[d] for d in values[1::2])) % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @: neither side of the pattern can hold one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield ("email", start, done)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four fixed patterns that pass their checks, by start, then kind."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups()):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 64:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _tokens(text: str, taken: list[tuple[str, int, int]]):
    """Tokens with enough digits that overlap no span, without marks around them."""
    end, spans, k = 0, sorted((s[1], s[2]) for s in taken), 0
    for m in _DIGITS.finditer(text):
        if m.start() < end:
            continue
        start, end = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        token = text[start:end]
        a = start + len(token) - len(token.lstrip(_TRIM))
        b = start + len(token.rstrip(_TRIM))
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        if sum("0" <= c <= "9" for c in text[a:b]) >= MIN_DIGITS:
            yield a, b


def _word(word: str) -> str:
    return _DIGITS.sub("0", word.strip(_TRIM).lower())


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a position: two words before it, and one on either side."""
    before = ["^", "^", *text[max(0, start - REACH) : start].split()][-2:]
    after = [*text[end : end + REACH].split()[:1], "$"][0]
    a, b, c = _word(before[0]), _word(before[1]), _word(after)
    return [f"{a} {b} _", f"{b} _ {c}"]


def _scan(docs: DataFrame) -> DataFrame:
    """Base results, and tokens with their contexts; ``seed`` is a base span's kind."""
    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "base array<struct<start:int,rank:int,end:int>>, "
        "tokens array<struct<start:int,end:int,value:long,seed:string,contexts:array<long>>>"
    )

    def make():
        import xxhash

        number = lambda s: xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)

        def token(text, start, end, seed):
            keys = [number(c) for c in contexts(text, start, end)]
            return {"start": start, "end": end, "value": number(text[start:end]), "seed": seed, "contexts": keys}

        def each(batch):
            ids, texts = columns(batch, "doc_id", "text")
            out = []
            for text in texts:
                text = text or ""
                spans = base_spans(text) if _DIGITS.search(text) or "@" in text else []
                tokens = [token(text, s, e, kind) for kind, s, e in spans]
                tokens += [token(text, s, e, None) for s, e in _tokens(text, spans)]
                kinds = [s[0] for s in spans]
                base = [{"start": s, "rank": KINDS.index(k), "end": e} for k, s, e in spans]
                out.append((*(kinds.count(k) for k in KINDS), spans_digest(spans_text(spans)), base, tokens))
            cols = list(zip(*out, strict=True))
            span = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
            item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("seed", pa.string()), ("contexts", pa.list_(pa.int64()))])
            types = (*[pa.int64()] * 4, pa.string(), pa.list_(span), pa.list_(item))
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, cols, types)], names=names)

        return each

    return map_batches(docs.select("doc_id", "text"), schema, make)


def trusted_instances(
    occurrences: DataFrame, store: Store, rounds: int, support: float, trust: float, accept: float
) -> DataFrame:
    """(value, kind) of instances without a seed that trusted patterns agree on.

    ``occurrences`` has value, seed and context.  A pattern's confidence for a kind is the
    score of its instances of that kind over its number of distinct instances; it counts
    from ``trust`` on and with a total score of at least ``support``.  An instance's score
    is 1 if it is a seed, else the chance that one of its patterns is right.  All steps are
    combinable aggregates over distinct (pattern, instance) pairs.
    """
    edges = store.keep(occurrences.select("context", "value").distinct(), "edges")
    seeds = occurrences.filter("seed IS NOT NULL").select("value", F.col("seed").alias("kind")).distinct()
    seeds = store.keep(seeds.withColumn("score", F.lit(1.0)), "seeds")
    sizes = store.keep(edges.groupBy("context").agg(F.count(F.lit(1)).alias("size")), "sizes")
    known = seeds
    for number in range(rounds):
        held = edges.join(known, "value").groupBy("context", "kind").agg(F.sum("score").alias("mass"))
        patterns = held.filter(F.col("mass") >= support).join(sizes, "context")
        patterns = patterns.select("context", "kind", (F.col("mass") / F.col("size")).alias("trust")).filter(F.col("trust") >= trust)
        doubt = F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999))))
        scored = edges.join(patterns, "context").groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("score"))
        scored = store.keep(scored.join(seeds.select("value"), "value", "left_anti"), f"round_{number}")
        known = seeds.unionByName(scored)
    best = F.max(F.struct("score", "kind")).alias("best")
    chosen = scored.filter(F.col("score") >= accept).groupBy("value").agg(best)
    return store.keep(chosen.select("value", F.col("best.kind").alias("kind")), "found")


def find_pii(
    docs: DataFrame, rounds: int = 3, support: float = 3.0, trust: float = 0.5, accept: float = 0.7
) -> DataFrame:
    """doc_id, counts and digest of base spans, all spans, and n_found, one row per input row.

    Spans found by context never overlap base spans.  NULL and empty texts have none; rows
    with equal ids are independent.  Without seeds nothing is added.
    """
    store = Store(docs.sparkSession, "pii")
    scanned = store.keep(_scan(docs).withColumn("row", F.monotonically_increasing_id()), "scanned")
    tokens = scanned.select("row", F.inline("tokens"))
    occurrences = tokens.select("value", "seed", F.explode("contexts").alias("context"))
    found = trusted_instances(occurrences, store, rounds, support, trust, accept)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct("start", rank.alias("rank"), "end")
    extra = tokens.filter("seed IS NULL").join(found, "value").groupBy("row").agg(F.collect_list(span).alias("extra"))
    joined = scanned.drop("tokens").join(extra, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(scanned.schema["base"].dataType))))
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    text = F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"]))
    return joined.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.array_join(text, ",").alias("spans"),
        F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_found"),
    )
