"""Quality by compression with dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmart.llm.common import durable, free_names, held_out, label_sample

#: The most labelled rows that are used, half for the dictionaries and half for the calibration; the most pieces of a
#: class that train its dictionary, and their length; the size of a dictionary.
SAMPLE_ROWS, PIECES, PIECE_CHARS, DICTIONARY, LEVEL = 16_384, 16_384, 512, 112 << 10, 3
#: Bytes of a window; inputs of the calibration, the constant among them.
WINDOW, FEATURES = 512, 5


@dataclass
class Model:
    bad: bytes
    good: bytes
    weights: list[float]


class _Sizes:
    """Compressed sizes of a text under both dictionaries; an empty dictionary compresses without one."""

    def __init__(self, model: Model):
        self.by = [self._compressor(model.bad), self._compressor(model.good)]

    @staticmethod
    def _compressor(raw: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if not raw:
            return zstandard.ZstdCompressor(**options)
        # without training samples enough for a table of its own, the text itself serves as the dictionary
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        known = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=known, **options)

    def features(self, text: str) -> tuple[float, ...]:
        """1, and the normalised size difference of the whole text, its worst window, the lower quartile and the median.

        The difference is (bad - good) / (bad + good) of the compressed sizes, in tenths. Windows cover the whole text;
        a last one of less than half a window is part of the one before it.
        """
        raw = text.encode("utf-8", "replace")
        ends = [*range(WINDOW, len(raw) - WINDOW // 2 + 1, WINDOW), len(raw)]
        bad, good = ([len(c.compress(raw[a:b])) for a, b in zip([0, *ends], ends, strict=False)] for c in self.by)
        apart = sorted(10 * (x - y) / (x + y) for x, y in zip(bad, good, strict=True))
        return 1.0, 10 * (sum(bad) - sum(good)) / (sum(bad) + sum(good)), apart[0], apart[(len(apart) - 1) // 4], apart[(len(apart) - 1) // 2]


def _dictionary(rows: pd.DataFrame) -> pd.DataFrame:
    pieces = [t.encode("utf-8", "replace") for t in rows.sort_values("at")["piece"]]
    try:
        raw = zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        raw = b"\n".join(pieces)[-DICTIONARY:]
    return pd.DataFrame({"y": [int(rows["y"].iloc[0])], "raw": [raw]})


def _measured(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = _Sizes(model)
        for rows in batches:
            table = np.array([sizes.features(t) for t in rows["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame({"y": rows["y"].to_numpy(), **{f"f{i}": table[:, i] for i in range(1, FEATURES)}})

    return run


def calibrated(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit_quality(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Dictionaries from one half of a bounded sample of the labelled rows, calibration on the other half.

    At most ``sample_rows`` whole texts are used. For the dictionaries they are cut in pieces, of which PIECES of each
    class (those with the smallest hash) train its dictionary in a task of their own; the driver gets two
    dictionaries of fixed size and four numbers for each calibration row. Where one class has no row, its dictionary
    is empty, and the calibration says how often the other one occurs.
    """
    sample = durable(label_sample(documents, labels, "quality", sample_rows, 3, 1).withColumn("half", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(2))))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("text")), F.lit(PIECE_CHARS)), lambda i: F.struct(i.alias("i"), F.substring(F.col("text"), i, F.lit(PIECE_CHARS)).alias("piece")))
    pieces = sample.where("half = 0").select("y", "doc_id", F.explode(cuts).alias("c")).select("y", "c.piece", F.xxhash64(F.lit(31), "doc_id", "c.i").alias("at"))
    raw = {0: b"", 1: b""}
    for y in raw:
        chosen = pieces.where(F.col("y") == y).orderBy("at").limit(PIECES)
        raw |= {r["y"]: bytes(r["raw"]) for r in chosen.groupBy("y").applyInPandas(_dictionary, "y int, raw binary").collect()}
    model = Model(raw[0], raw[1], [])
    rows = sample.where("half = 1").select("text", "y").mapInPandas(_measured(model), "y int, " + ", ".join(f"f{i} double" for i in range(1, FEATURES))).toPandas()
    x = np.column_stack([np.ones(len(rows)), rows[[f"f{i}" for i in range(1, FEATURES)]].to_numpy()])
    model.weights = calibrated(x, rows["y"].to_numpy(float)).tolist()
    return model


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, w = _Sizes(model), np.array(model.weights)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                table = np.array([sizes.features(t) for t in batch["text"].to_pylist()]).reshape(-1, FEATURES)
                score = 1 / (1 + np.exp(-np.clip(table @ w, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    A text is compressed window by window with a dictionary of bad and with one of good text. The normalised difference
    of the sizes, of the whole text, its worst window, lower quartile and median, goes through a logistic calibration. Rows with crc32(doc_id) mod 3
    equal to 1 are never learned from. Null and empty texts get the score of an empty text; without labels every score
    is 0.5. Several labels of an id count as the largest; equal texts get equal scores. An empty table gives no rows;
    columns other than doc_id and text (and quality) are ignored.
    """
    model = fit_quality(documents, labels)
    inputs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    return inputs.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose text scores at least ``threshold``, with their own columns, in one pass over the texts.

    Null and empty texts have the score of an empty text, equal texts (ties, repeated rows, repeated and null ids)
    stay or go together; without labels every score is 0.5, which stays at the threshold left out. An empty table gives
    no rows.
    """
    model = fit_quality(documents, labels)
    names = documents.columns

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes, w = _Sizes(model), np.array(model.weights)
        for part in texts:
            table = np.array([sizes.features(t) for t in part]).reshape(-1, FEATURES)
            yield pd.Series(1 / (1 + np.exp(-np.clip(table @ w, -35, 35))))

    (judged,) = free_names(documents, "_quality_score")
    return documents.withColumn(judged, score(F.coalesce("text", F.lit("")))).where(F.col(judged) >= threshold).select(*names)
