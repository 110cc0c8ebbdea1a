"""Operator 7: quality rules, line first.

Every line is judged alone: does it end like a sentence, is it navigation, is it
boilerplate, is it mostly symbols or capitals, does it repeat an earlier line.
Lines that fail go; a document that loses more than half of its word characters
to this is rejected, as is one that fails the base rules. Counts cover the whole
text.

Null and empty texts have no words and fail the base rules. Columns named like an
output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.packed import Words, covered, slices
from factloom.llm.tables import documents

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
MORE = ("n_lines", "n_lines_removed", "lost_chars")
OUTPUTS = (*BASE, *MORE, "cleaned")

# What a line may end with, what navigation puts between links,
# and phrases of page furniture.
SENTENCE_ENDS = ".!?…:;\"'”’»)]"
LINK_SEPARATORS = ("|", ">", "»", "›", "·")
BOILERPLATE = (
    "all rights reserved", "accept cookies", "use of cookies", "uses cookies", "privacy policy", "terms of use",
    "terms of service", "enable javascript", "click here", "sign up for", "subscribe to our", "back to top",
    "powered by", "lorem ipsum",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_BLANK = " \t\x0b\x0c\r"
_DROP_BLANK = str.maketrans("", "", _BLANK)
_DROP_SYMBOLS = str.maketrans("", "", SYMBOLS)
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_CAPITAL, _SMALL = re.compile("[A-Z]"), re.compile("[a-z]")


def line_fails(line: str) -> bool:
    """Whether a line with at least one word is to go."""
    words = line.encode().split()
    if line.rstrip(_BLANK)[-1] not in SENTENCE_ENDS:
        return True
    links = sum(line.count(s) and words.count(s.encode()) for s in LINK_SEPARATORS)
    if links >= 3 and 4 * links >= len(words):
        return True
    if 10 * (len(line) - len(line.translate(_DROP_SYMBOLS))) > len(words):
        return True
    if len(words) >= 5 and len(_CAPITAL.findall(line)) > 4 * len(_SMALL.findall(line)):
        return True
    return _FURNITURE.search(line.lower()) is not None


def clean_lines(text: str) -> tuple[list[str], int, int, int, int]:
    """Lines that stay; lines with words, lines removed, lines equal to an earlier one, lost word characters."""
    kept, seen = [], set()
    n = removed = repeated = lost = 0
    for line in text.split("\n"):
        chars = len(line.translate(_DROP_BLANK))
        if not chars:
            kept.append(line)
            continue
        n += 1
        again = line in seen
        seen.add(line)
        repeated += again
        if again or line_fails(line):
            removed += 1
            lost += chars
        else:
            kept.append(line)
    return kept, n, removed, repeated, lost


def _repeat_words(words: Words) -> np.ndarray:
    """Per row: words inside a window of five that the row holds twice or more."""
    start, hashes = words.windows(WINDOW)
    order = np.lexsort((hashes, words.row[start]))
    s, h, r = start[order], hashes[order], words.row[start[order]]
    same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marked = covered(s[twice], np.full(int(twice.sum()), WINDOW), len(words.start))
    total = np.concatenate([[0], np.cumsum(marked)])
    return total[words.first_of[1:]] - total[words.first_of[:-1]]


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with the base counts, the verdict and the cleaned text."""
    columns = [c for c in docs.columns if c not in OUTPUTS]
    symbol = np.isin(np.arange(256), list(SYMBOLS.encode()))
    blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = Words(batch.column(text))
            chars = _per_row(~blank[words.data] & ((words.data & 0xC0) != 0x80), words.bounds)
            symbols = _per_row(symbol[words.data], words.bounds)
            repeat = _repeat_words(words)
            lines = [clean_lines(t or "") for t in batch.column(text).to_pylist()]
            kept, n, removed, again, lost = zip(*lines, strict=True)
            failed = (words.count < 10) | (100 * repeat > 20 * words.count)
            verdict = ~failed & (2 * np.array(lost, np.int64) <= chars)
            values = [words.count, chars, symbols, np.array(again, np.int64), repeat, failed, verdict,
                      np.array(n, np.int64), np.array(removed, np.int64), np.array(lost, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), *map(pa.array, values), pa.array(["\n".join(k) for k in kept])],
                names=[*columns, *OUTPUTS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["long"] * 3 + ["string"]
    return docs.mapInArrow(run, schema + "".join(f", {c} {k}" for c, k in zip(OUTPUTS, kinds, strict=True)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", *BASE, *MORE)


_W = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_W}') AS words
  FROM documents
), lines AS (
  SELECT rid, no, line, regexp_extract_all(line, '{_W}') AS ws,
         row_number() OVER (PARTITION BY rid, line ORDER BY no) > 1 AS again
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS no FROM docs)
  WHERE regexp_matches(line, '{_W}')
), judged AS (
  SELECT rid, again, list_sum(list_transform(ws, lambda w: length(w))) AS chars,
         again
         OR NOT contains({_quoted(SENTENCE_ENDS)}, right(ws[-1], 1))
         OR (len(list_filter(ws, lambda w: w IN ({", ".join(map(_quoted, LINK_SEPARATORS))}))) >= 3
             AND 4 * len(list_filter(ws, lambda w: w IN ({", ".join(map(_quoted, LINK_SEPARATORS))}))) >= len(ws))
         OR 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) > len(ws)
         OR (len(ws) >= 5 AND len(regexp_extract_all(line, '[A-Z]')) > 4 * len(regexp_extract_all(line, '[a-z]')))
         OR regexp_matches(lower(line), {_quoted("|".join(BOILERPLATE))}) AS fails
  FROM lines
), by_line AS (
  SELECT rid, count(*) AS n_lines, count_if(fails) AS n_lines_removed, count_if(again) AS n_dup_lines,
         coalesce(sum(chars) FILTER (fails), 0) AS lost_chars
  FROM judged GROUP BY rid
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM docs)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM twice, range(5) AS s(o) GROUP BY rid
), base AS (
  SELECT d.rid, d.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed,
         coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM docs d LEFT JOIN by_line USING (rid) LEFT JOIN repeats r USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost_chars <= word_chars AS kept,
       n_lines, n_lines_removed, lost_chars
FROM base
"""

QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": ORACLE}
