"""Operator 8: token counts under a unigram vocabulary (count-only Viterbi).

Aho-Corasick lists all vocabulary pieces by their end; dynamic programming
carries the best score and its piece count per place, never the pieces. Of equal
scores the longer piece wins, as in the tokenizer libraries: candidates are
compared in the order of their start and only a better one replaces an earlier
one. A character that no single piece covers costs the lowest score less 10; with
byte pieces in the vocabulary it counts one token per UTF-8 byte, else a run of
such characters counts one.

Spaces become the meta symbol and a text gets one in front. Pieces hold meta
symbols only in front, so a text falls apart into words with the spaces before
them, and the count of a word is remembered. Null and empty texts have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.packed import slices
from factloom.llm.tables import documents

PIECES_FILE = "piece_bpe_32k.model"
META = "▁"
UNKNOWN_PENALTY = 10.0
OUTPUTS = ("n_tokens", "score")
MEMO_ENTRIES, MEMO_CHARS = 500_000, 48


def read_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Ordinary pieces with their scores, and whether unknown characters fall back to bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], any(model.is_byte(i) for i in ids)


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool) -> None:
        self._fallback = byte_fallback
        self._unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._pieces_in = self._automaton.iter if len(self._automaton) else lambda word: ()
        inner = any(META in piece.lstrip(META) for piece, _ in pieces)
        # White space that is in no piece stands alone; it ends a word too.
        alone = "".join(c for c in "\t\n\r" if not any(c in piece for piece, _ in pieces)) if byte_fallback else ""
        self._cut = re.compile(f"[{alone}]|{META}*[^{META}{alone}]+|{META}+" if alone else f"{META}*[^{META}]+|{META}+") if not inner else None
        self._memo: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        # The automaton lists pieces by their end and those of one end from the longest
        # on, so starts come in order and every end is settled before a later one asks.
        size = len(word)
        best, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        end, top, n, single = 1, None, 0, False
        for last, (length, score) in self._pieces_in(word):
            while end <= last:
                if single:
                    best[end], count[end] = top, n
                else:
                    self._step(word, end, top, n, best, count, unknown)
                end, top, single = end + 1, None, False
            start = end - length
            score += best[start]
            if top is None or score > top:
                top, n = score, count[start] + 1
            if length == 1:
                single = True
        while end <= size:
            if single:
                best[end], count[end] = top, n
            else:
                self._step(word, end, top, n, best, count, unknown)
            end, top, single = end + 1, None, False
        return count[size], best[size]

    def _step(self, word: str, end: int, top: float | None, n: int, best: list[float], count: list[int], unknown: list[bool]) -> None:
        """Settle an end whose last character no single piece covers."""
        score = best[end - 1] + self._unknown
        if top is None or score > top:
            fresh = len(word[end - 1].encode()) if self._fallback else int(not unknown[end - 1])
            top, n, unknown[end] = score, count[end - 1] + fresh, True
        best[end], count[end] = top, n

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = META + text.replace(" ", META)
        memo, n, score = self._memo, 0, 0.0
        for word in self._cut.findall(text) if self._cut else (text,):
            found = memo.get(word)
            if found is None:
                found = self.word(word)
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[word] = found
            n += found[0]
            score += found[1]
        return n, score


_COUNTERS: dict[int, Counter] = {}


def token_counts(
    docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True, text: str = "text"
) -> DataFrame:
    """The documents with ``n_tokens`` and the ``score`` of the best segmentation.

    Columns named like an output are replaced.
    """
    columns = [c for c in docs.columns if c not in OUTPUTS]
    shipped = docs.sparkSession.sparkContext.broadcast((pieces, byte_fallback))  # one vocabulary, about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shipped.id if hasattr(shipped, "id") else id(shipped)
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(*shipped.value)
        counter = _COUNTERS[key]
        for batch in slices(batches, text):
            found = [counter.text(t or "") for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns),
                 pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                names=[*columns, *OUTPUTS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return docs.mapInArrow(run, f"{schema}, n_tokens long, score double")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, fallback = read_pieces(public_tokenizers.path(PIECES_FILE))
    return token_counts(documents(spark, sf_dir, "doc_id", "text"), pieces, fallback).select("doc_id", *OUTPUTS)


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
