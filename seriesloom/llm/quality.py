"""Quality by compression: zstandard dictionaries of good and of bad text, and the difference of compressed sizes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import arrow_map

#: Bounds of the labelled sample a model is fitted on: documents per class for the
#: dictionaries, documents for the calibration, and pieces taken of each of the former.
FIT_DOCS, CALIBRATION_DOCS, FIT_PIECES = 2000, 4000, 8
#: Texts are compressed piece by piece, so that a text's repetitions of itself count little.
PIECE_BYTES = 512
DICTIONARY_BYTES = 400_000
LEVEL = 3


class Model(NamedTuple):
    """Dictionaries for (bad, good) text and the logistic calibration of the size features."""

    bad: bytes
    good: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


class _Sizes:
    """Features of a text: normalised size difference, difference a byte, and compression ratio."""

    def __init__(self, model: Model):
        self.bad, self.good = _compressor(model.bad), _compressor(model.good)

    def __call__(self, text: bytes) -> tuple[float, float, float]:
        bad = good = 0
        for i in range(0, len(text), PIECE_BYTES):
            piece = text[i : i + PIECE_BYTES]
            bad += len(self.bad.compress(piece))
            good += len(self.good.compress(piece))
        n = max(len(text), 1)
        return (bad - good) / max(bad, good, 1), (bad - good) / n, min(bad, good) / n


def size_features(docs: DataFrame, model: Model) -> DataFrame:
    """Replace ``text`` by ``normalised, per_byte, ratio``; null and empty texts have zeros."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["normalised double", "per_byte double", "ratio double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(sent.value)
        for batch in batches:
            found = np.array([sizes((t.as_py() or "").encode()) for t in batch.column("text")]).reshape(-1, 3)
            columns = [batch.column(f.name) for f in keep] + [pa.array(found[:, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in keep], "normalised", "per_byte", "ratio"])

    return docs.mapInArrow(run, schema)


def train_dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of ``pieces``; too few pieces to train on become its content as they are."""
    pieces = [p for p in pieces if len(p) >= 8]
    most = min(size, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(max(most, 1024), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most ``2 * FIT_DOCS + CALIBRATION_DOCS`` of ``labels(doc_id, label)``, taken by a hash of their id.

    Half of the labelled ids (by another bit of the hash) give the dictionaries, the others the
    calibration, so that no text is judged by a dictionary that holds it.  Of ids with
    contradicting labels none is taken; of documents that share an id the smallest text is.
    Without labels of both kinds every score is the share of good labels, or 0.5 without any.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .filter(F.col("label") == F.col("_most"))
        .select("doc_id", "label", F.xxhash64("doc_id", F.lit("sample")).alias("_h"))
    )
    first = known.filter(F.pmod("_h", F.lit(2)) == 0)
    parts = [first.filter(F.col("label") == y).orderBy("_h", "doc_id").limit(FIT_DOCS) for y in (0, 1)]
    rest = known.filter(F.pmod("_h", F.lit(2)) == 1).orderBy("_h", "doc_id").limit(CALIBRATION_DOCS)
    taken = parts[0].unionByName(parts[1]).unionByName(rest).withColumn("_fit", F.pmod("_h", F.lit(2)) == 0).drop("_h")
    # At most 2 * FIT_DOCS + CALIBRATION_DOCS ids: a proven bound.
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    sample = chosen.groupBy("doc_id", "label", "_fit").agg(F.min("text").alias("text"))
    pieces = ([], [])
    for label, some in arrow_map(sample.filter("_fit").select("label", "text"), _some_pieces, "label int, pieces array<binary>").collect():
        pieces[label].extend(bytes(p) for p in some)
    model = Model(train_dictionary(sorted(pieces[0])), train_dictionary(sorted(pieces[1])), (0.0,) * 4, (0.0,) * 3, (1.0,) * 3)
    rows = size_features(sample.filter("NOT _fit").select("doc_id", "label", "text"), model).orderBy("doc_id").collect()
    x = np.array([[r.normalised, r.per_byte, r.ratio] for r in rows]).reshape(-1, 3)
    return model._replace(**_logistic(x, np.array([r.label for r in rows], dtype=float)))


def _some_pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Up to ``FIT_PIECES`` pieces spread evenly over each text."""
    out = []
    for text in batch.column("text"):
        data = text.as_py().encode()
        starts = range(0, len(data), PIECE_BYTES)
        chosen = {starts[k * len(starts) // FIT_PIECES] for k in range(FIT_PIECES)} if starts else set()
        out.append([data[i : i + PIECE_BYTES] for i in sorted(chosen)])
    yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.binary()))], ["label", "pieces"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> dict:
    """Ridge logistic regression by Newton steps on standardised features."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return {"weights": (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0)}
    means, scales = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - means) / scales]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return {k: tuple(map(float, v)) for k, v in (("weights", w), ("means", means), ("scales", scales))}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text``, with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    found = size_features(docs, model)
    names = ("normalised", "per_byte", "ratio")
    logit = F.lit(model.weights[0])
    for k, name in enumerate(names):
        logit = logit + F.lit(model.weights[k + 1]) * (F.col(name) - F.lit(model.means[k])) / F.lit(model.scales[k])
    return (
        found.withColumn("score", 1 / (1 + F.exp(-logit)))
        .drop(*names)
        .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    )


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns; ``labels`` is the table of labels."""
    model = fit(docs, learnable(labels))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    weights, means, scales = (np.array(x) for x in (model.weights, model.means, model.scales))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(sent.value)
        for batch in batches:
            found = np.array([sizes((t.as_py() or "").encode()) for t in batch.column("text")]).reshape(-1, 3)
            yield batch.filter(pa.array(weights[0] + ((found - means) / scales) @ weights[1:] >= 0))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` of the quality labels that may be learned from."""
    return labels.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("label"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document, from its whole text alone.

    A null text counts as empty; repeated rows are scored alike; other columns are ignored.
    """
    model = fit(docs, learnable(labels))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
