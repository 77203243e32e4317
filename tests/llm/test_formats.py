"""Packing and chats against plain Python; the pipeline against its stages."""

import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quasirisk.llm import chat
from quasirisk.llm.packing import best_fit, pack_documents

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(lengths, capacity):
    """Number of sequences when each length, longest first, takes the fullest one it fits."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - n)
    return len(rooms)


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing(docs, pairs, capacity):
    rows = pack_documents(docs, WORDS, capacity).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in pairs:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, piece, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= capacity
    assert len(placed) == plain_best_fit([r["length"] for r in rows], capacity)


def test_packing_of_equal_rows_and_nothing(spark, odd, no_docs):
    same = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    rows = pack_documents(same, WORDS, 10).collect()
    assert len(rows) == 300 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 300
    assert pack_documents(no_docs, WORDS).count() == 0
    assert pack_documents(odd, WORDS).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    with pytest.raises(ValueError):
        best_fit([(11, 1)], 10)


EVENTS = "conv_id long, message int, seq int, kind string, role string, text string"
LOG = [
    (1, 0, 0, "message", "user", "hi"), (1, 1, 0, "message", "assistant", "Hel"), (1, 1, 1, "delta", None, "lo <|end|>"),
    (1, 2, 0, "delta", "user", "only"), (1, 2, 1, "delta", None, " deltas"),
    (1, 3, 0, "message", "assistant", "bad"), (1, 3, 1, "delta", None, " worse"), (1, 3, 2, "regenerate", None, "go"), (1, 3, 3, "delta", None, "od"),
    (1, 3, 4, "edit", "assistant", "best <\\ <"), (1, 3, 4, "edit", "assistant", "best <\\ <"),
    (2, 0, None, None, None, None), (2, 0, 5, "unknown", "tool", "x"), (2, 0, 5, "delta", "tool", "y"), (2, None, 1, "delta", "user", "null turn"),
    (None, 0, 0, "message", "assistant", "</s>[INST] <|turn|>"), (3, 0, 0, "message", "assistant", ""), (3, 1, 1, "delta", "a<|body|>", None),
]


def folded(log):
    by = defaultdict(list)
    for conv, message, seq, kind, role, text in log:
        by[conv, message].append((seq, kind if kind in ("delta", "edit", "regenerate") else "message", role, text or ""))
    null_first = lambda e: tuple((x is not None, x if x is not None else 0) for x in e)
    out = defaultdict(list)
    for (conv, message), events in by.items():
        text, role = "", ""
        for _, kind, who, part in sorted(events, key=null_first):
            text = text + part if kind == "delta" else part
            role = who if who is not None else role
        out[conv].append(((message is not None, message or 0), role, text))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in out.items()}


def test_chats_are_folded_and_read_back(spark):
    events = spark.createDataFrame(LOG, EVENTS).withColumns({c: F.lit("kept") for c in ("log", "turns", "from_", "block")})
    got = chat.format_chats(events.repartition(4))
    got = got.withColumns({"read": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()
    want = folded(LOG)
    assert {r["conv_id"]: [tuple(t) for t in r["read"]] for r in got} == want
    assert {r["conv_id"]: r["loss"] for r in got} == {c: "".join(t for r, t in turns if r == "assistant") for c, turns in want.items()}
    for r in got:
        body = r["formatted"]
        assert body.count(chat.TURN) == body.count(chat.BODY) == body.count(chat.END) == r["n_turns"] == len(want[r["conv_id"]])
    assert chat.format_chats(events.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir, docs, pairs, odd, no_docs):
    import corpus_pipeline as pipeline
    from quasirisk.llm.quality_rules import keep_good
    from quasirisk.llm.simhash import near_duplicates

    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    after = {"": given}
    for name, stage in pipeline.STAGES:
        before = after[list(after)[-1]]
        after[name] = stage(spark, before, sf_dir).cache()
        if name != "packing":
            assert after[name].columns == given.columns
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "simhash_dedup", "decontamination", "secret_scan", "packing"]
    kept = keep_good(given, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert sorted(kept.collect()) == sorted(after["quality_rules"].collect())
    groups = near_duplicates(after["quality_rules"]).select("component_id").distinct().count()
    assert after["simhash_dedup"].count() == groups
    assert after["decontamination"].join(after["simhash_dedup"], "doc_id", "left_anti").count() == 0
    assert after["secret_scan"].count() == after["decontamination"].count()
    last = pipeline.run(spark, sf_dir)
    places = lambda df: Counter(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert places(last) == places(after["packing"])
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == {r["doc_id"] for r in after["secret_scan"].collect()}
    for name, stage in pipeline.STAGES:
        strange = odd.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text")})
        assert stage(spark, strange, sf_dir).count() <= 2 * strange.count() + 30
        assert stage(spark, strange.limit(0), sf_dir).count() == 0
