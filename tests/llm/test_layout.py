"""Packing, mixing and sharding."""

from __future__ import annotations

import random
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from llm_rows import documents, with_clashes
from pyspark.sql import functions as F

from quillmart.llm import mixing, packing, sharding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check_packed(df, tokenizer):
    """Pieces give every document's ids back, and fill sequences without gaps or overlap."""
    rows = packing.pack_documents(df, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = [x & 0xFFFFFFFF for x in r["ids"]]
        assert len(ids) == r["length"] <= 1024 and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["piece"], r["start"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    texts = Counter((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect())
    assert set(by_doc) == {i for i, _ in texts}
    for (i, text), copies in texts.items():
        if sum(n for (j, _), n in texts.items() if j == i) > copies:
            continue  # other texts under the same id
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[i])[::copies]
        assert [x for _, _, p in pieces for x in p] == ids
        assert len(pieces) == -(-len(ids) // 1024) and all(len(p) == 1024 for _, _, p in pieces[1:])
        assert [s for _, s, _ in pieces] == [len(ids) - sum(len(p) for _, _, p in pieces[k:]) for k in range(len(pieces))]
    return rows, len(by_sequence)


def test_packing_round_trip(small_docs, tokenizer):
    rows, sequences = check_packed(small_docs.repartition(1), tokenizer)
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert sequences <= 1.02 * least + 1


def test_packing_edges(edge, no_documents, tokenizer):
    check_packed(with_clashes(edge), tokenizer)
    assert packing.pack_documents(no_documents).collect() == []


def test_encoder_equals_whole_texts(tokenizer):
    rnd = random.Random(3)
    alphabet = "ab 1.é\n\t    '-_ñ😀\x00"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "  a", "a ", "one", "a <|endoftext|> b", "x<|endoftext|> y", "a \x85b \x1cc \u3000d \u200be \u180ef \xa0 g «h» —i"]
    texts += [" ".join(rnd.choice(["la", "l\u0301e", "über", "x1", "…", "٣٤", "don't", "<|endof", "\x00"]) + str(rnd.randrange(999)) for _ in range(200)) for _ in range(20)]
    encoder, begin = packing.Encoder(packing.default_tokenizer()), 0
    ids, ends = encoder.encode(pa.array(texts))
    for text, end in zip(texts, ends, strict=True):
        assert ids[begin:end].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        begin = end
    assert [x.tolist() for x in encoder.encode(pa.array(texts).slice(7, 1))[0:1]] == [[*tokenizer.encode(texts[7], add_special_tokens=False).ids, 2]]


def test_encoder_holds_few_bytes_a_word(tokenizer):
    encoder, texts = packing.Encoder(packing.default_tokenizer()), pa.array([" ".join(f"w{i % 50}" for i in range(400_000))])
    encoder.encode(texts)
    tracemalloc.start()
    try:
        encoder.encode(texts)
        assert tracemalloc.get_traced_memory()[1] < 45 * 400_000
    finally:
        tracemalloc.stop()


def test_best_fit_equals_a_plain_list_of_bins():
    rnd = random.Random(7)
    bins, plain, made = packing.BestFit(64, 5), {}, 0
    for _ in range(3000):
        length = rnd.randrange(1, 65)
        b, at = bins.put(length)
        fits = sorted(f for f in plain.values() if f >= length)
        if fits:
            assert plain[b] == fits[0] and at == 64 - fits[0]
        else:
            assert b == made and at == 0
            plain[b], made = 64, made + 1
        plain[b] -= length
        if not plain[b]:
            del plain[b]
        if len(plain) > 5:
            closed = min(plain.values())
            ties = [k for k, f in plain.items() if f == closed]
            gone = [k for k in ties if k not in bins.free[closed]]
            assert len(gone) == 1
            del plain[gone[0]]


def brute_deviation(order, parts, block_rows):
    """Most blocks that any source is off its target after any whole slot, while all sources last."""
    period, seen, worst = sum(parts.values()), Counter(), 0
    for slot, source in enumerate(order):
        seen[source] += 1
        worst = max(worst, max(abs(seen[k] - (slot + 1) * a / period) for k, a in parts.items()))
    return worst


@pytest.mark.parametrize("shares", [{"a": 1.0}, {"a": 5.0, "b": 1.0}, {"a": 0.335, "b": 0.335, "c": 0.2, "d": 0.1, "e": 0.03}, {str(k): 1.0 / (k + 1) for k in range(40)}])
def test_pfair_deviates_by_less_than_a_block(shares):
    parts = mixing.parts_of(shares)
    plan = mixing.pfair_period(parts)
    assert [slot for _, _, slot, _, _ in plan] == list(range(sum(parts.values())))
    assert all(release <= slot < deadline for _, _, slot, release, deadline in plan)
    assert Counter(k for k, *_ in plan) == parts
    assert brute_deviation([k for k, *_ in plan] * 2, parts, 1) < 1


def test_mix_places_every_row_once(small_docs):
    rows = mixing.mix_sources(small_docs, block_rows=4).collect()
    assert len(rows) == small_docs.count()
    assert len({(r["_slot"], r["_within"]) for r in rows}) == len(rows)
    assert len({(r["_k"], r["_block"]) for r in rows}) == len({r["_slot"] for r in rows})
    assert all(r["_release"] <= r["_slot"] < r["_deadline"] for r in rows)


def brute_mix(rows, block_rows, period=4096, exponent=0.7):
    """(source, block, slot) of every block: at each slot the released block with the earliest deadline, in plain Python."""
    counts = Counter(s for s in rows)
    parts = mixing.parts_of({("-" if s is None else f"={s}"): n**exponent for s, n in counts.items()}, period)
    whole = sum(parts.values())
    blocks = {k: -(-n // block_rows) for k, n in ((("-" if s is None else f"={s}"), n) for s, n in counts.items())}
    done, out, slot = dict.fromkeys(parts, 0), [], 0
    while any(done[k] < blocks[k] for k in parts):
        ready = [k for k in parts if done[k] * whole // parts[k] <= slot]
        k = min(ready, key=lambda k: (-(-(done[k] + 1) * whole // parts[k]), k))
        if done[k] < blocks[k]:
            out.append((k, done[k], slot))
        done[k] += 1
        slot += 1
    last = min(max(s for k, _, s in out if k == x) for x in parts)
    return {(k, b, s, s <= last) for k, b, s in out}


def test_op9_equals_a_brute_force_mix(spark, sf_dir, small_docs):
    from quillmart.llm import queries

    rows = queries.op9_mixing(spark, sf_dir).collect()
    sources = [r["source"] for r in small_docs.select("source").collect()]
    key = lambda s: "-" if s is None else f"={s}"
    assert {(key(r["source"]), r["block"], r["slot"], r["bounded"]) for r in rows} == brute_mix(sources, 16)
    assert Counter(r["source"] for r in rows) == Counter(sources) and len({r["doc_id"] for r in rows}) == len(rows)
    assert len({(r["slot"], r["place_in_block"]) for r in rows}) == len(rows) and max(r["place_in_block"] for r in rows) < 16
    skewed = [(i, "t", None, "a" if i < 700 else ("b" if i % 2 else None)) for i in range(1000)]
    got = mixing.mix_sources(documents(spark, skewed), block_rows=4).collect()
    assert {(r["_k"], r["_block"], r["_slot"], r["_bounded"]) for r in got} == brute_mix([s for *_, s in skewed], 4)


def test_mix_weights_edges_and_columns(spark, edge, no_documents):
    wide = with_clashes(edge)
    kept = mixing.mixed_documents(wide)
    assert kept.columns == wide.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, wide.collect()))
    only = mixing.mix_sources(edge, weights={None: 1.0, "wiki": 3.0, "absent": 2.0, "web": 0.0}).collect()
    assert {r["_k"] for r in only} == {"-", "=wiki"} and len(only) == edge.where("source IS NULL OR source = 'wiki'").count()
    assert mixing.mix_sources(no_documents).collect() == [] and mixing.mixed_documents(no_documents).collect() == []


def check_shards(df, shards):
    rows = sharding.stratified_shards(df, shards).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    counts, slots = Counter(r["shard"] for r in rows), defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r["law"] for r in rows} <= {"rows"} and all(r["grown_shard"] is None for r in rows)
    return rows


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i}", None, "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(2000)]
    df = documents(spark, rows)
    got = check_shards(df, 40)
    source, per = {i: s for i, _, _, s in rows}, defaultdict(Counter)
    for r in got:
        per[r["shard"]][source[r["doc_id"]]] += 1
    whole = Counter(source.values())
    assert all(abs(per[s][k] - n / 40) <= 2 for s in range(40) for k, n in whole.items())
    assert sorted(map(tuple, sharding.stratified_shards(df.repartition(7)).drop("grown_shard").collect())) == sorted(tuple(r)[:-1] for r in got)


def test_shards_edges(small_docs, edge, no_documents):
    check_shards(small_docs, 40)
    check_shards(with_clashes(edge), 40)
    check_shards(edge.withColumn("source", F.lit("one")), 3)
    assert sharding.stratified_shards(no_documents).collect() == []
