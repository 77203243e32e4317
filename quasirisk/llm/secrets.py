"""Secrets in texts: key assignments, access keys, digests and strings no tokenizer expects.

Random strings are found by their token efficiency: a vocabulary learnt from text needs
about one token for four characters of prose, but one for every one or two characters of a
random key.  Known digests and identifiers are left out before the test.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quasirisk.llm.store import map_batches
from quasirisk.llm.text import columns, spans_digest, spans_text

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Characters of keys in common encodings.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Digests of 32, 40, 48, 56, 64, 96 or 128 hex digits, UUIDs, and numbers.
_KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{48}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}"
    r"|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9_+/=-]+)"
)
#: Identifiers: words of letters, with a number behind, joined by _ - or /.  A block of equal
#: case belongs to one word only, so nothing is ever given back and matching is linear.
_NAME = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]++)(?:[_/-]?(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+))*+[_/-]?[0-9]*+=*+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three fixed patterns, by start, then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def make_random_test(ranks_path: str, max_ratio: float = 2.0):
    """Function from a text to the spans of its random strings.

    A candidate is a run of at least 20 key characters with a letter and a digit that is
    neither a known digest nor an identifier.  It is random if it has fewer than
    ``max_ratio`` characters per token.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    encoding = tiktoken.Encoding(
        "secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )

    def random_spans(text: str) -> list[tuple[str, int, int]]:
        found = []
        for m in _RUN.finditer(text):
            run = m[0]
            if not re.search("[0-9]", run) or not re.search("[A-Za-z]", run):
                continue
            if _KNOWN.fullmatch(run) or _NAME.fullmatch(run):
                continue
            if len(run) < max_ratio * len(encoding.encode_ordinary(run)):
                found.append(("random", m.start(), m.end()))
        return found

    return random_spans


def all_spans(text: str, random_spans) -> tuple[list, list]:
    """Base spans, and base spans with the random strings that overlap none of them."""
    base = base_spans(text)
    starts = [b[1] for b in base]
    reach = list(accumulate((b[2] for b in base), max))
    # Of the base spans that start before the end of a candidate, the one that reaches farthest decides.
    extra = [s for s in random_spans(text) if not (n := bisect_left(starts, s[2])) or reach[n - 1] <= s[1]]
    return base, sorted(base + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SCANNED = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
)


def scan_secrets(docs: DataFrame, ranks_path: str, max_ratio: float = 2.0) -> DataFrame:
    """Spans of secrets per row of (doc_id, text); a projection, without a shuffle.

    NULL and empty texts have no spans; every input row gives one output row.
    """

    def make():
        random_spans = make_random_test(ranks_path, max_ratio)

        def each(batch):
            ids, texts = columns(batch, "doc_id", "text")
            out = []
            for text in texts:
                base, spans = all_spans(text or "", random_spans)
                kinds = [s[0] for s in spans]
                out.append((*(kinds.count(k) for k in KINDS), spans_digest(spans_text(base)), spans_text(spans)))
            a, b, c, d, digest, spans = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(digest),
                 pa.array(spans), pa.array(d, pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

        return each

    return map_batches(docs.select("doc_id", "text"), SCANNED, make)


def redact_secrets(docs: DataFrame, ranks_path: str, max_ratio: float = 2.0, mark: str = "[SECRET]") -> DataFrame:
    """Replace every span by ``mark`` in ``text``; overlapping spans become one mark.

    All columns are carried; ``n_chars``, if present, is the new length.  NULL stays NULL.
    """
    at = {name: i for i, name in enumerate(docs.columns)}

    def make():
        random_spans = make_random_test(ranks_path, max_ratio)

        def clean(text):
            if not text:
                return text
            _, spans = all_spans(text, random_spans)
            parts, end = [], 0
            for _, start, stop in spans:
                if start >= end:
                    parts += [text[end:start], mark]
                end = max(end, stop)
            return "".join([*parts, text[end:]]) if spans else text

        def each(batch):
            texts = [clean(t) for t in columns(batch, "text")[0]]
            arrays = list(batch.columns)
            arrays[at["text"]] = pa.array(texts, batch.schema.field(at["text"]).type)
            if "n_chars" in at:
                kind = batch.schema.field(at["n_chars"]).type
                arrays[at["n_chars"]] = pa.array([None if t is None else len(t) for t in texts]).cast(kind)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

        return each

    return map_batches(docs, docs.schema, make)
