"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import held_out

#: n-gram length in bytes of lower-cased UTF-8, hash buckets, and the most languages that a model may have.
GRAM, BUCKETS, MOST_LANGUAGES = 3, 1 << 16, 400
#: A language enters the set if it raises the log-likelihood by this much for each unit of log(number of n-grams).
PENALTY = 6.0
ROUNDS, TOLERANCE = 30, 1e-4
#: Digits, ASCII signs and white space count as one blank.
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint32)


#: Bytes of a text that are turned into n-grams at once.
_PORTION = 1 << 20


def buckets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of a text and how often each occurs; a shorter text is filled up with blanks.

    At most BUCKETS of either, however long the text is.
    """
    raw = raw.ljust(GRAM)
    last = len(raw) - GRAM + 1
    total = np.zeros(BUCKETS, np.int64) if last > _PORTION else None
    for at in range(0, last, _PORTION):
        data = _FOLD[np.frombuffer(raw, np.uint8, min(_PORTION, last - at) + GRAM - 1, at)]
        grams = np.zeros(len(data) - GRAM + 1, np.uint32)
        for k in range(GRAM):
            grams = grams * np.uint32(257) + data[k : k + len(grams)]
        grams = (grams * np.uint32(2654435761)) >> np.uint32(16)
        if total is None:
            return np.unique(grams, return_counts=True)
        total += np.bincount(grams, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def _counted(languages: list[str]):
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found, times = buckets(text.as_py().encode())
                totals[place[lang.as_py()], found] += times
        l, g = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(l, pa.int32()), pa.array(g, pa.int32()), pa.array(totals[l, g], pa.int64())], names=["l", "g", "n"])

    return run


def fit_languages(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log p(bucket | language), add-half smoothed, from all rows that are not held out.

    Tasks count into one table of languages by buckets and Spark sums the tables. What reaches the driver is at most
    MOST_LANGUAGES * BUCKETS counts, whatever the input; more languages are an error.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.full((BUCKETS, len(languages)), 0.5)
    if languages:
        parts = known.select(F.lower("text").alias("text"), "lang").mapInArrow(_counted(languages), "l int, g int, n long")
        table = parts.groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
        np.add.at(counts, (table["g"].to_numpy(), table["l"].to_numpy()), table["n"].to_numpy().astype(float))
    return languages, np.log(counts / counts.sum(0)).astype(np.float32)


def mixture(p: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns' languages and the log-likelihood, by expectation-maximisation.

    p[i, l] is the likelihood of n-gram i under language l, scaled so that the best of a row is 1; the n-gram occurs
    times[i] times.
    """
    k, n = p.shape[1], float(times.sum())
    share = np.full(k, 1.0 / k, p.dtype)
    if k == 1:
        return share, float(times @ np.log(p[:, 0]))
    weight = times.astype(p.dtype)
    for _ in range(ROUNDS):
        new = share * (p.T @ (weight / (p @ share))) / p.dtype.type(n)
        moved = np.abs(new - share).max()
        share = new / new.sum()
        if moved < TOLERANCE:
            break
    return share, float(times @ np.log(p @ share))


def language_set(p: np.ndarray, times: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Chosen languages, largest share first, and their shares.

    The mixture of all languages ranks them. Beginning with the best single one, the next language by share joins as
    long as the penalised likelihood grows.
    """
    n, k = float(times.sum()), p.shape[1]
    single = times @ np.log(p)
    chosen, share, best = [int(single.argmax())], np.ones(1), float(single.max())
    if k == 1:
        return chosen, share
    full, _ = mixture(p, times)
    cost = PENALTY * np.log(n + 1.0)
    for l in np.argsort(-full):
        if l in chosen:
            continue
        trial = [*chosen, int(l)]
        if full[l] * n < 1:
            break
        part, likelihood = mixture(np.ascontiguousarray(p[:, trial]), times)
        if likelihood - best <= cost:
            break
        chosen, share, best = trial, part, likelihood
    order = np.argsort(-share, kind="stable")
    return [chosen[i] for i in order], share[order]


def _predicted(languages: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                pred, score, sets, shares = [], [], [], []
                for letters, text in zip(batch["letters"].to_pylist(), batch["text"], strict=True):
                    if not letters or not languages:
                        pred.append("und"), score.append(0.0), sets.append([]), shares.append([])
                        continue
                    found, times = buckets(text.as_py().encode())
                    chosen, share = language_set(scaled[found], times)
                    pred.append(languages[chosen[0]]), score.append(float(min(1.0, share[0])))
                    sets.append([languages[i] for i in chosen]), shares.append([float(x) for x in share])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["held_out"], pa.array(pred), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    names=["doc_id", "held_out", "lang_pred", "score", "langs", "shares"],
                )

    return run


def identify_languages(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs, shares for every document.

    Byte n-grams of the whole lower-cased text are a mixture of the learned languages; expectation-maximisation
    estimates the proportions, and the language set is the one with the best penalised likelihood. lang_pred has the
    largest share of the set, which is the score. Rows with crc32(doc_id) mod 5 equal to 0 are never learned from, nor
    are rows with null text, language or id; language, source and id are no inputs of a prediction.

    A text is held as its distinct n-grams with their counts, at most BUCKETS however long it is.
    A text that is null or has no letter is ``und`` with score 0; if nothing can be learned, every text is. Equal
    texts get equal answers. An empty table gives no rows; other columns are ignored.
    """
    rows = documents.select("doc_id", "text", "lang")
    languages, table = fit_languages(rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    inputs = rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.lower(text).alias("text"), text.rlike(r"\p{L}").alias("letters"))
    scaled = np.exp(table - table.max(1, keepdims=True)) if languages else table
    shared = documents.sparkSession.sparkContext.broadcast(scaled)  # at most MOST_LANGUAGES * BUCKETS small floats
    return inputs.mapInArrow(_predicted(languages, shared), "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")
