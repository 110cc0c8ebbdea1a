"""Operator 4: quality classifier by perplexity.

An interpolated modified Kneser-Ney model of byte n-grams per language is trained
on all trusted text. Documents are dealt to chunks by id and text. A chunk lists its
distinct n-grams once with their trusted counts; counts, continuation counts and
probabilities are joins on (language, n-gram), sharded by that key, and every
chunk gets back the probabilities of its own n-grams only. Nothing of the model
is held whole anywhere, and what is gathered follows the text.

A fifth of the trusted documents is kept out of training; their perplexities give
each language's threshold, a quantile. A document above it is rejected, as is one
without text. A language of fewer trusted documents than that takes is cross-fitted:
all its documents are dealt to five folds, each scored by a model of the trusted
ones of the other folds, so that every trusted document gives a value and stands
for those scored as it was. With fewer than ``NEEDED`` of them the quantile cannot
be stated; then the threshold is the language's median times an excess, or the
largest value of its trusted documents if that is more. The excess is one number
for all such languages: the quantile, pooled over all languages, of value by
median of the language, and ``EXCESS`` at least. A language without a trusted
document has no model that could tell documents apart and rejects no text.

A null language is a language of its own. Rows of one id are scored each by itself
and trusted alike. Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.functions.skew import broadcast_if_small
from factloom.llm.packed import byte_column, slices
from factloom.llm.tables import documents
from factloom.session import durable

ORDER = 5
QUANTILE = 0.995
CHUNK_BYTES = 24 << 20
CALIBRATION_PARTS = 5
# Calibration documents that a quantile of 0.995 takes.
NEEDED = 200
EXCESS = 2.0
NO_LANGUAGE = "und"
OUTPUTS = ("n_bytes", "perplexity", "threshold", "keep")
_PAD = b"\n" * (ORDER - 1)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as a number, and the row bounds."""
    padded = pa.array([_PAD + t if t else b"" for t in texts.cast(pa.large_binary()).to_pylist()], pa.large_binary())
    data, bounds = byte_column(padded)
    sizes = np.maximum(np.diff(bounds) - len(_PAD), 0)
    n = max(0, len(data) - ORDER + 1)
    gram = np.zeros(n, np.uint64)
    for k in range(ORDER):
        gram = (gram << np.uint64(8)) | data[k: n + k]
    starts = bounds[:-1][sizes > 0]
    inside = np.zeros(n + 1, np.int64)
    inside[starts] += 1
    np.add.at(inside, starts + sizes[sizes > 0], -1)
    return gram[np.cumsum(inside[:-1]) > 0], np.concatenate([[0], np.cumsum(sizes)])


def _pieces(table: pa.Table) -> Iterator[pa.RecordBatch]:
    return slices(iter(table.combine_chunks().to_batches()))


_UNFOLDED = "-"


def _named(language: Column, trusted: Column) -> Column:
    """Name of the model that scores a row: its fold, if its language is cross-fitted, and its language."""
    fold = F.pmod(F.xxhash64("_key"), F.lit(CALIBRATION_PARTS)).cast("string")
    return F.concat(F.when(trusted < CALIBRATION_PARTS * NEEDED, fold).otherwise(F.lit(_UNFOLDED)), F.lit(":"), language)


def _is_calibration() -> Column:
    """Trusted rows of this kind are kept out of the training of the model that scores them."""
    return ~F.col("_lang").startswith(_UNFOLDED) | (F.pmod(F.xxhash64("_key"), F.lit(CALIBRATION_PARTS)) == 0)


def _is_training() -> Column:
    """Trusted rows of this kind train a model: that of their language, or those of the other folds."""
    return ~F.col("_lang").startswith(_UNFOLDED) | ~_is_calibration()


def _trained(counts: DataFrame) -> DataFrame:
    """Counts of each model, from counts by the model that scores the rows: those of the other folds."""
    folded = counts.filter(~F.col("_lang").startswith(_UNFOLDED))
    others = F.filter(F.array(*[F.lit(str(k)) for k in range(CALIBRATION_PARTS)]), lambda k: k != F.substring("_lang", 1, 1))
    folded = folded.withColumn("_other", F.explode(others)).select(
        F.concat("_other", F.expr("substring(_lang, 2)")).alias("_lang"), "_gram", "_n")
    folded = durable(folded.groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n")))
    return counts.filter(F.col("_lang").startswith(_UNFOLDED)).union(folded)


def _list_grams(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """Distinct n-grams of a chunk with their count in its training rows."""
    train = np.isin(docs.column("_key").to_numpy(), trusted.column("_key").to_numpy())
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part, weight in ((docs.filter(pa.array(train)), 1), (docs.filter(pa.array(~train)), 0)):
        for piece in _pieces(part):
            k, c = np.unique(_grams(piece.column("text"))[0], return_counts=True)
            keys.append(k)
            counts.append(c * weight)
    types, which = np.unique(np.concatenate(keys), return_inverse=True)
    summed = np.bincount(which, weights=np.concatenate(counts), minlength=len(types))

    def repeated(name: str) -> pa.Array:
        return pa.repeat(docs.column(name)[0], len(types)) if len(docs) else pa.array([], docs.schema.field(name).type)

    return pa.table({"_lang": repeated("_lang"), "_chunk": repeated("_chunk"), "_gram": types.view(np.int64), "_n": summed.astype(np.int64)})


def _scorer(columns: list[str], schema: pa.Schema):
    def score(docs: pa.Table, probabilities: pa.Table) -> pa.Table:
        """The rows of a chunk with their perplexity, from the chunk's log-probabilities."""
        out = []
        grams, logs = (probabilities.column(c).to_numpy() for c in ("_gram", "_log"))
        order = np.argsort(grams)
        known, values = grams[order].view(np.uint64), logs[order].astype(np.float64)
        for piece in _pieces(docs):
            gram, bounds = _grams(piece.column("text"))
            total = np.concatenate([[0.0], np.cumsum(values[np.searchsorted(known, gram)] if len(gram) else [])])
            n = np.diff(bounds)
            mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)
            found = pa.array(np.where(n > 0, np.exp(-mean), np.nan), from_pandas=True)
            out.append(pa.RecordBatch.from_arrays([*(piece.column(c) for c in columns), pa.array(n), found], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return score


def _suffix(n: int) -> Column:
    """An n-gram without its first byte."""
    return F.col("_gram").bitwiseAND((1 << (8 * (n - 1))) - 1)


def _discount(count: Column) -> Column:
    return F.when(count == 1, F.col("_d1")).when(count == 2, F.col("_d2")).otherwise(F.col("_d3"))


def _model(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1: (language, n-gram, discounted share) and (language, context, weight of the lower order)."""
    levels = [counts]
    for n in range(ORDER, 1, -1):
        # Below the top a count is the number of distinct bytes in front.
        lower = levels[0].select("_lang", _suffix(n).alias("_gram")).groupBy("_lang", "_gram").agg(F.count("*").alias("_n"))
        levels.insert(0, durable(lower))
    out = []
    for level in levels:
        of = [F.sum((F.col("_n") == k).cast("double")).alias(f"_c{k}") for k in (1, 2, 3, 4)]
        y = F.col("_c1") / (F.col("_c1") + 2 * F.col("_c2"))

        def d(k: int, y: Column = y) -> Column:
            formula = k - (k + 1) * y * F.col(f"_c{k + 1}") / F.col(f"_c{k}")
            usable = (F.col("_c1") > 0) & (F.col(f"_c{k}") > 0)
            return F.greatest(F.lit(0.1), F.least(F.lit(float(k)), F.when(usable, formula).otherwise(F.lit(k / 2)))).alias(f"_d{k}")

        discounts = level.groupBy("_lang").agg(*of).select("_lang", d(1), d(2), d(3))
        cut = level.join(discounts, "_lang").withColumn("_cut", F.least(F.col("_n"), _discount(F.col("_n"))))
        context = F.shiftright("_gram", 8).alias("_context")
        totals = cut.groupBy("_lang", context).agg(F.sum("_n").alias("_total"), F.sum("_cut").alias("_cuts"))
        weights = totals.select("_lang", "_context", "_total", (F.col("_cuts") / F.col("_total")).alias("_weight"))
        out.append((cut.select("_lang", "_gram", (F.col("_n") - F.col("_cut")).alias("_share")), weights))
    return out


def _probabilities(needed: DataFrame, counts: DataFrame) -> DataFrame:
    """Log-probability of every needed n-gram, from the lowest order up."""
    wanted = [needed]
    for n in range(ORDER, 1, -1):
        wanted.insert(0, durable(wanted[0].select("_lang", _suffix(n).alias("_gram")).distinct()))
    lower = None
    for n, (types, (shares, weights)) in enumerate(zip(wanted, _model(counts), strict=True), start=1):
        rows = types.withColumn("_context", F.shiftright("_gram", 8)).withColumn("_suffix", _suffix(n))
        rows = rows.join(shares, ["_lang", "_gram"], "left").join(weights, ["_lang", "_context"], "left")
        below = F.lit(1 / 256)
        if lower is not None:
            rows = rows.join(lower.select("_lang", F.col("_gram").alias("_suffix"), F.col("_p").alias("_below")), ["_lang", "_suffix"])
            below = F.col("_below")
        own = F.coalesce(F.col("_share") / F.col("_total"), F.lit(0.0))
        # One query per order: the plan of all five together strains the driver.
        lower = durable(rows.select("_lang", "_gram", (own + F.coalesce(F.col("_weight"), F.lit(1.0)) * below).alias("_p")))
    return lower.select("_lang", "_gram", F.log("_p").alias("_log"))


def _in_chunks(docs: DataFrame, trusted_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, and the trusted ones' keys, dealt to chunks of one language and bounded size."""
    sizes = durable(docs.groupBy("_lang").agg(F.sum(F.octet_length("text")).alias("_bytes")))
    total = sizes.agg(F.sum("_bytes")).first()[0] or 0
    per_chunk = max(1, min(CHUNK_BYTES, total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = sizes.select("_lang", (F.coalesce("_bytes", F.lit(0)) / per_chunk + 1).cast("int").alias("_parts"))

    # Rows of one id, as of none, go to as many chunks as others.
    dealt = docs.join(broadcast_if_small(parts), "_lang").withColumn("_chunk", F.pmod(F.hash("_key", "text"), "_parts")).drop("_parts")
    trusted = durable(dealt.select("_key", "_lang", "_chunk").join(trusted_ids, "_key", "left_semi").distinct())
    return dealt, trusted


def perplexities(docs: DataFrame, trusted_ids: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns, size and perplexity per row. ``docs`` has _key (id), _lang (``_named``) and text, ``trusted_ids`` _key."""
    docs, ids = _in_chunks(docs, trusted_ids)
    training = ids.filter(_is_training())
    grams = durable(
        docs.groupBy("_lang", "_chunk").cogroup(training.groupBy("_lang", "_chunk"))
        .applyInArrow(_list_grams, "_lang string, _chunk int, _gram long, _n long"))
    types = durable(grams.groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n")))
    logs = _probabilities(types.select("_lang", "_gram"), _trained(types.filter("_n > 0")))
    logs = logs.withColumn("_log", F.col("_log").cast("float"))
    answers = durable(grams.select("_chunk", "_lang", "_gram").join(logs, ["_lang", "_gram"]))
    fields = [f for f in docs.schema if f.name in carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_bytes long, perplexity double"
    names = [f.name for f in fields]
    arrow = to_arrow_schema(docs.select(*[F.col(f"`{n}`") for n in names]).schema)
    arrow = arrow.append(pa.field("n_bytes", pa.int64())).append(pa.field("perplexity", pa.float64()))
    return docs.groupBy("_lang", "_chunk").cogroup(answers.groupBy("_lang", "_chunk")).applyInArrow(_scorer(names, arrow), schema)


def thresholds_of(values: DataFrame, trusted: DataFrame, quantile: float) -> DataFrame:
    """Threshold per language _name, from perplexities of calibration documents and the numbers of trusted ones."""
    own = values.groupBy("_name").agg(
        F.percentile_approx("perplexity", quantile, 10_000).alias("_own"), F.percentile_approx("perplexity", 0.5, 10_000).alias("_median"),
        F.max("perplexity").alias("_most"))
    own = durable(own.join(trusted, "_name"))
    relative = values.join(broadcast_if_small(own), "_name").select((F.col("perplexity") / F.col("_median")).alias("_excess"))
    pooled = relative.agg(F.percentile_approx("_excess", quantile, 10_000).alias("_excess")).first()[0]
    few = F.greatest(F.col("_median") * max(EXCESS, pooled or 0.0), "_most")
    return durable(own.select("_name", F.when(F.col("_trusted") < NEEDED, few).otherwise(F.col("_own")).alias("threshold")))


def classify(
    docs: DataFrame, trusted_ids: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id",
    quantile: float = QUANTILE, carry: list[str] | None = None,
) -> DataFrame:
    """The documents (``carry`` columns, all by default) with size, perplexity, threshold and verdict.

    ``trusted_ids`` has the ids of trusted documents in its first column.
    """
    carry = [c for c in carry or docs.columns if c not in OUTPUTS]
    language = F.coalesce(F.col(lang), F.lit(NO_LANGUAGE)).alias("_lang")
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    mine = dict.fromkeys([*carry, text])
    rows = docs.select(*[F.col(f"`{c}`") for c in mine], key.alias("_key"), language)
    rows = rows if text == "text" else rows.withColumn("text", F.col(f"`{text}`"))
    ids = trusted_ids.select(F.col(trusted_ids.columns[0]).cast("long").alias("_key")).filter("_key IS NOT NULL").distinct()
    trusted = rows.select("_key", "_lang").join(ids, "_key", "left_semi").distinct()
    trusted = durable(trusted.groupBy(F.col("_lang").alias("_name")).agg(F.count("*").alias("_trusted")))  # a row per language
    rows = rows.withColumnRenamed("_lang", "_name").join(broadcast_if_small(trusted), "_name", "left")
    rows = rows.withColumn("_lang", _named(F.col("_name"), F.col("_trusted"))).drop("_trusted")
    scored = durable(perplexities(rows, ids, [*carry, "_key", "_lang", "_name"]))
    values = durable(
        scored.filter(_is_calibration() & F.col("perplexity").isNotNull())
        .join(ids, "_key", "left_semi").select("_name", "perplexity"))
    thresholds = thresholds_of(values, trusted, quantile)
    keep = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return scored.join(broadcast_if_small(thresholds), "_name", "left").select(*carry, "n_bytes", "perplexity", "threshold", keep.alias("keep"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0").select("doc_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    trusted = trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs, trusted, carry=["doc_id", "lang"])


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLES: dict[str, str] = {}
