"""Operator 9: byte-level BPE encoding and decoding in linear time.

Bytes are read as Latin-1, so that one Aho-Corasick pass lists every vocabulary
entry at every place of a piece. Encoding takes the longest entry that is
compatible with the token before it and backtracks where none is: a sequence is
the BPE result exactly if all neighbours are compatible, a place from which no
token fits is never tried again, and compatibility of a pair is memoised.

Null text is empty text and gives no tokens. A piece that is itself an entry is
one token, as the tokenizer library has it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.packed import slices
from factloom.llm.tables import documents

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
OUTPUTS = ("token_ids", "decoded")
# Pieces whose encoding a worker remembers, in two generations.
MEMO_ENTRIES, MEMO_BYTES = 500_000, 64


class _Memo(dict):
    """Ids by piece, made on the first look-up. When it is full it becomes the old
    generation, from which pieces that still come up are taken over."""

    def __init__(self, encode) -> None:
        self._encode = encode
        self._old: dict[str, list[int]] = {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self._old.get(piece)
        if ids is None:
            ids = self._encode(piece)
        if len(piece) <= MEMO_BYTES:
            if len(self) >= MEMO_ENTRIES // 2:
                self._old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.words = ranks, {i: w for w, i in ranks.items()}
        self._split = regex.compile(pattern).findall
        self._automaton = ahocorasick.Automaton()
        for word, token in ranks.items():
            if len(word) > 1:
                self._automaton.add_word(word.decode("latin-1"), (len(word), token))
        self._automaton.make_automaton()
        self._single = [ranks.get(bytes([b])) for b in range(256)]
        self._reachable: list[bool | None] = [None] * (max(self.words, default=-1) + 1)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._pairs: dict[int, bool] = {}
        self._memo = _Memo(lambda piece: self.piece(piece.encode()))
        self._tokens = pa.array([self.words.get(i, b"") for i in range(max(self.words, default=-1) + 1)], pa.large_binary())

    def _survives(self, left: int, right: int, until: float) -> bool:
        """Whether no merge across the border of two tokens comes before ``until``.

        Merges are undone from the last one backwards; at every moment only the
        two pieces at the border can merge.
        """
        while True:
            joined = self.ranks.get(self.words[left] + self.words[right])
            if joined is not None and joined < until:
                return False
            made_left = left if len(self.words[left]) > 1 else -1
            made_right = right if len(self.words[right]) > 1 else -1
            if made_left > made_right:
                until, left = left, self.parts(left)[1]
            elif made_right >= 0:
                # Of equal merges the left one goes first.
                until, right = right + 1, self.parts(right)[0]
            else:
                return True

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merging never makes it."""
        if token not in self._parts:
            word, found = self.words[token], None
            for cut in range(1, len(word)):
                left, right = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if left is not None and right is not None and max(self._made(left), self._made(right)) < token \
                        and self.reachable(left) and self.reachable(right) and self._survives(left, right, token):
                    found = (left, right)
                    break
            self._parts[token] = found
        return self._parts[token]

    def _made(self, token: int) -> int:
        return token if len(self.words[token]) > 1 else -1

    def reachable(self, token: int) -> bool:
        known = self._reachable[token]
        if known is None:
            known = self._reachable[token] = len(self.words[token]) == 1 or self.parts(token) is not None
        return known

    def compatible(self, left: int, right: int) -> bool:
        known = self._pairs.get(left << 20 | right)
        if known is None:
            if len(self._pairs) > 4 * MEMO_ENTRIES:
                self._pairs.clear()
            known = self._pairs[left << 20 | right] = self._survives(left, right, float("inf"))
        return known

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # Entries of two bytes or more that begin at each place, the longest last; those of one byte fit anywhere.
        longer: dict[int, list[tuple[int, int]]] = {}
        known, pairs = self._reachable, self._pairs
        for last, (length, token) in self._automaton.iter(piece.decode("latin-1")):
            if known[token] or known[token] is None and self.reachable(token):
                at = last + 1 - length
                if at in longer:
                    longer[at].append((last + 1, token))
                else:
                    longer[at] = [(last + 1, token)]
        size, at, before, dead, path = len(piece), 0, -1, set(), []
        fits = longer.get(0, ())
        choice = len(fits) - 1
        while at < size:
            while choice >= -1:
                end, token = fits[choice] if choice >= 0 else (at + 1, self._single[piece[at]])
                if end not in dead:
                    if before < 0:
                        break
                    fine = pairs.get(before << 20 | token)
                    if self.compatible(before, token) if fine is None else fine:
                        break
                choice -= 1
            if choice >= -1:
                path.append((at, choice, fits, before))
                at, before = end, token
                fits = longer.get(at, ())
                choice = len(fits) - 1
            else:
                dead.add(at)
                at, choice, fits, before = path.pop()
                choice -= 1
        return [*(p[3] for p in path[1:]), before]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._memo.__getitem__, self._split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of every list of ids."""
        lists = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self._tokens.take(ids.flatten()))
        return pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).cast(pa.binary())


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[tuple[bytes, str], Encoder] = {}


def encoder(file: bytes, pattern: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if (file, pattern) not in _ENCODERS:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file.splitlines())}
        _ENCODERS[file, pattern] = Encoder(ranks, pattern)
    return _ENCODERS[file, pattern]


def round_trip(docs: DataFrame, file: bytes, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """The documents with ``token_ids`` and ``decoded``, the bytes that the ids stand for.

    ``file`` is the content of a rank file. Columns named like an output are replaced.
    """
    columns = [c for c in docs.columns if c not in OUTPUTS]
    shipped = docs.sparkSession.sparkContext.broadcast(file)  # one vocabulary file, under a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shipped.value, pattern)
        for batch in slices(batches, text):
            found = [np.array(bpe.encode(value) if value else [], np.int32) for value in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), ids, bpe.decode_lists(ids)], names=[*columns, *OUTPUTS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns)
    return docs.mapInArrow(run, f"{schema}, token_ids array<int>, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = read_ranks(public_tokenizers.path(RANKS_FILE))
    found = round_trip(documents(spark, sf_dir, "doc_id", "text"), file)
    return digests(found.select("doc_id", "token_ids", "decoded"))


def digests(found: DataFrame) -> DataFrame:
    others = [c for c in found.columns if c not in OUTPUTS]
    return found.select(
        *others,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLES: dict[str, str] = {}
