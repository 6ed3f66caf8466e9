"""Language, toxicity and quality: held-out figures and edges."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest
from llm_rows import documents, labels, with_clashes

from quillmart.llm import langid, quality, queries, toxicity


def held(i, divisor, remainder):
    return i is None or zlib.crc32(str(i).encode()) % divisor == remainder


def rates(rows, truth):
    """(accuracy, recall of label 1, false alarms of label 0) over held-out rows."""
    pairs = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    ones, zeros = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return np.mean([p == y for p, y in pairs]), np.mean(ones), np.mean(zeros)


def test_language_of_held_out_documents(spark, medium_dir):
    rows = queries.op2_langid(spark, medium_dir).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{medium_dir}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert len(rows) == len(docs)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in judged]) >= 0.95


def test_language_mixture_and_edges(spark, edge, no_documents):
    english = "the house is on the hill and they will go there with all of their friends this evening "
    german = "das Haus steht auf dem Hügel und sie werden heute Abend mit allen ihren Freunden dorthin gehen "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de", None) for i in range(40)]
    rows += [(100, english * 5 + german * 5, None, None), (101, None, "en", None), (102, "123 ...", "en", None), (None, english, "en", None)]
    got = {r["doc_id"]: r for r in langid.identify_languages(documents(spark, rows)).collect()}
    assert sorted(got[100]["langs"]) == ["de", "en"] and abs(sum(got[100]["shares"]) - 1) < 1e-3
    assert got[101]["lang_pred"] == got[102]["lang_pred"] == "und" and got[102]["score"] == 0
    assert got[None]["lang_pred"] == "en" and got[None]["held_out"]
    assert got[1]["langs"] == ["en"] and got[0]["langs"] == ["de"]
    found = langid.identify_languages(with_clashes(edge)).collect()
    assert len(found) == 14 and {r["lang_pred"] for r in found if r["doc_id"] in (3, 4, 5, 7)} == {"und"}
    assert langid.identify_languages(no_documents).collect() == []


def plain_mixture(counts, likelihood, languages):
    """Shares of the languages by expectation-maximisation, in plain Python, and the log-likelihood."""
    share = {l: 1 / len(languages) for l in languages}
    for _ in range(400):
        new = dict.fromkeys(languages, 0.0)
        for g, c in counts.items():
            whole = sum(share[l] * likelihood[g][l] for l in languages)
            for l in languages:
                new[l] += c * share[l] * likelihood[g][l] / whole
        share = {l: x / sum(counts.values()) for l, x in new.items()}
    return share, sum(c * math.log(sum(share[l] * likelihood[g][l] for l in languages)) for g, c in counts.items())


def test_mixture_and_set_equal_plain_expectation_maximisation():
    rng = np.random.default_rng(9)
    p = rng.dirichlet(np.ones(40), size=4).T.astype(np.float32)
    likelihood = (p / p.max(1, keepdims=True)).tolist()
    for mix in ([1.0, 0, 0, 0], [0.6, 0.4, 0, 0], [0.3, 0.3, 0.4, 0]):
        grams = rng.choice(40, size=3000, p=np.array(p, float) @ mix / (np.array(p, float) @ mix).sum())
        found, times = np.unique(grams, return_counts=True)
        counts = dict(zip(found.tolist(), times.tolist(), strict=True))
        rows = np.array(likelihood, np.float32)[found]
        share, fit = langid.mixture(rows, times)
        want, best = plain_mixture(counts, likelihood, range(4))
        assert max(abs(share[l] - want[l]) for l in range(4)) < 0.02 and abs(fit - best) < 2  # thirty rounds against four hundred
        # the set with the best penalised likelihood among all sets, when languages differ this clearly
        chosen, _ = langid.language_set(rows, times)
        cost = langid.PENALTY * math.log(3001)
        sets = [[l for l in range(4) if s >> l & 1] for s in range(1, 16)]
        assert sorted(chosen) == max(sets, key=lambda s: plain_mixture(counts, likelihood, s)[1] - cost * len(s))


def test_grams_of_short_and_long_texts(monkeypatch):
    whole = bytes(random.Random(2).choices(b"abc d", k=5000))
    want = dict(zip(*(x.tolist() for x in langid.buckets(whole)), strict=True))
    monkeypatch.setattr(langid, "_PORTION", 700)
    assert dict(zip(*(x.tolist() for x in langid.buckets(whole)), strict=True)) == want and sum(want.values()) == 4998
    assert [x.tolist() for x in langid.buckets(b"a")] == [x.tolist() for x in langid.buckets(b"a  ")]
    assert langid.buckets(b"ab")[1].tolist() == [1]


def test_toxicity_on_held_out_documents(spark, medium_dir):
    medium_dir = medium_dir.replace("sf0.01", "sf0.1")  # toxic labels are rare: the smaller table holds six of them out
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{medium_dir}/labels.parquet").collect() if r["toxic"] is not None}
    rows = queries.op7_toxicity(spark, medium_dir).collect()
    accuracy, recall, alarms = rates(rows, truth)
    assert accuracy >= 0.95 and recall >= 0.7 and alarms <= 0.02, (accuracy, recall, alarms)
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_on_held_out_documents(spark, medium_dir):
    medium_dir = medium_dir.replace("sf0.01", "sf0.1")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{medium_dir}/labels.parquet").collect() if r["quality"] is not None}
    rows = queries.op8_quality(spark, medium_dir).collect()
    accuracy, recall, alarms = rates(rows, truth)
    held_labels = [truth[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert accuracy >= 0.96 > 1.05 * np.mean(held_labels) and recall >= 0.97 and alarms <= 0.1, (accuracy, recall, alarms)
    assert all(r["held_out"] == held(r["doc_id"], 3, 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_scores_equal_a_plain_computation(spark, sf_dir):
    """Every score again from the fitted dictionaries and weights, window by window, without the operator's helpers."""
    import zstandard

    docs, marks = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit_quality(docs, marks)

    def size(raw, dictionary):
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == bytes([0x37, 0xA4, 0x30, 0xEC]) else zstandard.DICT_TYPE_RAWCONTENT
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
        return len(zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))

    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, marks).collect()}
    for r in docs.orderBy("doc_id").limit(25).collect():
        raw, parts = (r["text"] or "").encode(), []
        while len(raw) >= 512 + 256:
            parts, raw = [*parts, raw[:512]], raw[512:]
        pairs = [(size(x, model.bad), size(x, model.good)) for x in [*parts, raw]]
        apart = sorted(10 * (b - g) / (b + g) for b, g in pairs)
        bad, good = sum(b for b, _ in pairs), sum(g for _, g in pairs)
        inputs = [1.0, 10 * (bad - good) / (bad + good), apart[0], apart[(len(apart) - 1) // 4], apart[(len(apart) - 1) // 2]]
        assert abs(scores[r["doc_id"]] - 1 / (1 + math.exp(-sum(w * x for w, x in zip(model.weights, inputs, strict=True))))) < 1e-9


def test_calibration_equals_gradient_descent():
    rng = np.random.default_rng(2)
    x = np.column_stack([np.ones(400), rng.normal(size=(400, 2))])
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.3, 1.2, -0.7])))).astype(float)
    w = np.zeros(3)
    for _ in range(5000):
        w -= 0.01 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 1e-2 * w)
    assert np.abs(quality.calibrated(x, y) - w).max() < 1e-6


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifier_edges(spark, edge, no_documents, score):
    none = labels(spark, [])
    marked = labels(spark, [(1, 1, 0), (2, 0, 1), (2, 1, 1), (6, 0, 1), (8, 1, 0), (None, 1, 1), (9, None, None), (10, 3, -1)])
    names = ["doc_id", "held_out", "score", "predicted"]
    blank = score(edge, none)
    assert blank.columns == names and {r["score"] for r in blank.collect()} == {0.5}
    rows = score(with_clashes(edge), marked.selectExpr("*", "'x' AS text", "'x' AS y", "'x' AS half")).collect()
    assert len(rows) == 14 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    assert score(no_documents, marked).collect() == [] and score(no_documents, none).collect() == []


def test_ftrl_makes_sparse_weights():
    rng = np.random.default_rng(0)
    examples = [(np.unique(np.append(rng.integers(100, 4000, 30), 7 if i % 3 == 0 else 8)), int(i % 3 == 0)) for i in range(600)]
    used, weights = toxicity.learn(examples)
    by = dict(zip(used.tolist(), weights.tolist(), strict=True))
    assert by[7] > 0 and len(used) < 1000 and by[7] == max(v for k, v in by.items() if k != toxicity.WIDTH)


def plain_ftrl(examples):
    """The update of every weight on its own, in plain Python."""
    rows = {}
    for x, _ in examples:
        for i in x.tolist():
            rows[i] = rows.get(i, 0) + 1
    l1 = max(1.0, toxicity.L1_PER_THOUSAND * len(examples) / 1000)
    ones = sum(y for _, y in examples)
    rare = max(1.0, ((len(examples) - ones) / ones) ** toxicity.RARE_POWER) if ones else 1.0
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for x, y in examples:
            used = [*(i for i in x.tolist() if rows[i] >= min(toxicity.LEAST_ROWS, len(examples))), toxicity.WIDTH]
            w = {i: weight(i) for i in used}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values())))))
            g = (p - y) * (rare if y else 1.0)
            for i in used:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if abs(z[i]) > l1}


@pytest.mark.parametrize("seed", [1, 2])
def test_ftrl_weights_equal_plain_python(seed):
    rng = np.random.default_rng(seed)
    examples = [(np.unique(np.append(rng.integers(0, 300, rng.integers(0, 25)), 5 if i % 4 == 0 else 6)), int(i % 4 == 0 or rng.random() < 0.05)) for i in range(250)]
    used, weights = toxicity.learn(examples)
    wanted = plain_ftrl(examples)
    assert set(used.tolist()) == set(wanted)
    assert np.allclose(weights, [wanted[i] for i in used.tolist()], rtol=1e-9, atol=1e-12)


def test_toxicity_weights_and_scores_equal_plain_python(spark, sf_dir, monkeypatch):
    """The fitted weights and every score again, from the texts alone, with features in parts and passes re-read."""
    monkeypatch.setattr(toxicity, "PASSES", 3)
    docs, marks = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    from pyspark.sql import functions as F

    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    truth = {r["doc_id"]: r["toxic"] for r in marks.collect() if r["toxic"] in (0, 1) and not held(r["doc_id"], 5, 0)}
    order = [r["doc_id"] for r in docs.select("doc_id").orderBy(F.xxhash64(F.lit(5), "doc_id")).collect() if r["doc_id"] in truth]
    wanted = plain_ftrl([(toxicity.features(text[i]), truth[i]) for i in order])
    used, weights = toxicity.fit_toxicity(docs, marks)
    assert set(used.tolist()) == set(wanted) and np.allclose(weights, [wanted[i] for i in used.tolist()], rtol=1e-9)
    for r in toxicity.score_toxicity(docs, marks).collect():
        total = sum(wanted.get(i, 0.0) for i in toxicity.features(text[r["doc_id"]]).tolist()) + wanted.get(toxicity.WIDTH, 0.0)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def test_learning_memory_does_not_grow_with_the_texts():
    """A thousand examples of 60,000 features, 240 MB a pass, read in parts: the learner stays far below that."""
    import tracemalloc

    import pyarrow as pa

    def batches():
        rng = np.random.default_rng(0)
        for turn in (0, 1):
            for row in range(1000):
                found = np.unique(rng.integers(0, toxicity.WIDTH, 60_000)).astype("<i4")
                parts = [found[k : k + toxicity.PART].tobytes() for k in range(0, len(found), toxicity.PART)]
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(parts)) for v in (turn, row, row, row % 2)] + [pa.array(parts, pa.binary())], names=["turn", "at", "row", "y", "x"])

    tracemalloc.start()
    (out,) = toxicity._learned(batches())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows > 0 and peak < 160e6, peak


def test_good_documents_keep_their_columns(spark, edge):
    wide = with_clashes(edge)
    kept = quality.good_documents(wide, labels(spark, [(1, 1, 0), (6, 0, 0)]))
    assert kept.columns == wide.columns
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(edge, labels(spark, [(1, 1, 0), (6, 0, 0)])).collect()}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, s in scored.items() if s >= 0.5}
