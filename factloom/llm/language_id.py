"""Operator 5: language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte n-grams. The document
frequencies come from all learning rows; each language's centroids come from
spherical k-means over a sample of about ``SAMPLE_ROWS`` of its distinct learning
texts (a documented bound; a language of fewer texts is taken whole, and copies of
a text count once), so every language with a text has centroids. A text gets the language
of the centroid with the highest cosine; one farther from it than nearly all of
the sample is flagged as rejected.

A null text or one without a letter is ``und`` with score 0, as is every text if
nothing could be learned. Rows without a language are not learned from. Columns
named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.packed import byte_column, mix, slices
from factloom.llm.tables import documents

FEATURES = 4096
ORDERS = (1, 2, 3)
CENTROIDS = 3
SAMPLE_ROWS = 400
ROUNDS = 8
REJECT_QUANTILE = 0.01
UNKNOWN = "und"
OUTPUTS = ("lang_pred", "score", "rejected")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_ROWS = 512  # rows of one dense block


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    """n-gram counts of the texts' letters, a dense block of rows at a time."""
    lowered = pa.array([_NO_LETTERS.sub(" ", (t or "").lower()) for t in column.to_pylist()], pa.large_string())
    for at in range(0, len(lowered), _ROWS):
        part = lowered.slice(at, _ROWS)
        data, bounds = byte_column(part)
        row = np.repeat(np.arange(len(part)), np.diff(bounds))
        counts = np.zeros(len(part) * FEATURES)
        for order in ORDERS:
            n = len(data) - order + 1
            if n <= 0:
                continue
            gram = np.full(n, order, np.uint64)
            for k in range(order):
                gram = (gram << np.uint64(8)) | data[k: n + k]
            inside = row[:n] == row[order - 1:]
            at_feature = row[:n] * FEATURES + (mix(gram) % np.uint64(FEATURES)).astype(np.int64)
            counts += np.bincount(at_feature[inside], minlength=len(counts))
        yield counts.reshape(len(part), FEATURES)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _vectors(column: pa.Array, idf: np.ndarray) -> Iterator[np.ndarray]:
    for counts in _blocks(column):
        yield _unit(np.log1p(counts) * idf)


def _document_frequencies(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES, np.int64)
        for batch in slices(batches, text):
            for counts in _blocks(batch.column(text)):
                seen += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES)), pa.array(seen)], names=["feature", "df"])

    return run


def clustered(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Unit centroids of unit vectors, and the cosine that few of them fall short of."""
    chosen = [0]
    best = vectors @ vectors[0]
    for _ in range(min(k, len(vectors)) - 1):
        chosen.append(int(np.argmin(best)))
        best = np.maximum(best, vectors @ vectors[chosen[-1]])
    centers = vectors[chosen]
    for _ in range(rounds):
        nearest = np.argmax(vectors @ centers.T, axis=1)
        centers = _unit(np.array([vectors[nearest == c].mean(axis=0) if (nearest == c).any() else centers[c] for c in range(len(centers))]))
    return centers, float(np.quantile((vectors @ centers.T).max(axis=1), REJECT_QUANTILE))


def sample(rows: DataFrame, texts: dict[str, int]) -> DataFrame:
    """About ``SAMPLE_ROWS`` distinct texts per language, which has so many (``texts``); all of a smaller one.

    Copies go before they are shuffled; none of them meet in the task of a language.
    """
    share = F.lit(0.0)
    for name, n in texts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, SAMPLE_ROWS / n))).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    return rows.filter(place < share).select("lang", "text").distinct()


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """IDF weights, and the language, centroid and rejection cosine of every centroid.

    What reaches the driver is ``FEATURES`` numbers per centroid and as many
    document frequencies, whatever the number of rows.
    """
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = rows.groupBy("lang", F.xxhash64("text").alias("hash")).count().groupBy("lang").agg(F.sum("count").alias("n"), F.count("*").alias("texts")).collect()
    frequencies = rows.select("text").mapInArrow(_document_frequencies("text"), "feature long, df long").groupBy("feature").agg(F.sum("df"))
    df = np.zeros(FEATURES)
    for feature, n in frequencies.collect():
        df[feature] = n
    idf = np.log((1 + sum(r.n for r in counts)) / (1 + df)) + 1

    def one_language(table: pa.Table) -> pa.Table:
        texts = pa.array(sorted(table.column("text").to_pylist()))
        centers, reject = clustered(np.concatenate(list(_vectors(texts, idf))))
        return pa.table({
            "lang": [table.column("lang")[0].as_py()] * len(centers), "center": [c.astype(np.float64).tobytes() for c in centers],
            "reject": [reject] * len(centers),
        })

    found = sample(rows, {r.lang: r.texts for r in counts}).groupBy("lang").applyInArrow(one_language, "lang string, center binary, reject double").collect()
    found = sorted(found, key=lambda r: (r.lang, r.center))
    centers = np.array([np.frombuffer(r.center) for r in found]).reshape(len(found), FEATURES)
    return idf, [r.lang for r in found], centers, np.array([r.reject for r in found])


def predict(docs: DataFrame, model: tuple[np.ndarray, list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    columns = [c for c in docs.columns if c not in OUTPUTS]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers per centroid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, centers, reject = shipped.value
        for batch in slices(batches, text):
            texts = batch.column(text)
            lettered = np.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()])
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if langs:
                at = 0
                for vectors in _vectors(texts, idf):
                    cosines = vectors @ centers.T
                    best[at: at + len(vectors)] = cosines.argmax(axis=1)
                    score[at: at + len(vectors)] = cosines.max(axis=1)
                    at += len(vectors)
            known = lettered & bool(langs)
            score = np.where(known, np.clip(score, 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns),
                 pa.array([langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]),
                 pa.array(score), pa.array(~known | (score < (reject[best] if langs else 0.0)))],
                names=[*columns, *OUTPUTS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", *OUTPUTS)


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
