"""Operator 12: BPE with word ends, by a lexicon transducer and exact merges.

The words of all documents are counted; the most frequent ones are encoded once and
compiled into a minimal acyclic transducer with id outputs (``lexicon``), which goes
as one file to every machine and is memory-mapped by its workers. A word outside it
is merged exactly: of all neighbours the pair of lowest rank, the leftmost first.
The size of the lexicon changes speed alone, never ids.

Text is taken apart as the vocabulary file says: special tokens first, then NFC,
lower case character by character, and then the words of its pattern.

Defined results: null text is empty text and gives no tokens; ids may be null or
repeat, every row is encoded by itself. A word of any length is merged with a heap,
in about 200 bytes of memory a character. An empty table gives no rows. Other columns
are kept; those named like an output, in any case, are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import normalizers

from factloom.llm.lexicon import Lexicon, compile_words
from factloom.llm.packed import slices
from factloom.llm.tables import documents
from factloom.session import durable

VOCABULARY_FILE = "word_bpe_49k.json"
OUTPUTS = ("token_ids", "decoded")
# Words of the transducer: about 4 MB, built by the driver in seconds.
LEXICON_WORDS = 1 << 17
# Longer words are neither put there nor remembered.
WORD_BYTES = 64
# Entries of a worker's memory of rare words and of a task's counter; they are emptied when full.
MEMO_ENTRIES = 200_000

# Texts below this character (whose lower case stays there) have their words found by
# plain classes of letters and digits, in half the time; other texts are normalised by the
# tokenizers' library, which knows the newest letters.
_COMMON = 0x180
_BEYOND = re.compile(f"[^\0-{chr(_COMMON - 1)}]").search
_NEWEST = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def _common(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_COMMON) if unicodedata.category(chr(c))[0] == kind)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """The tokenizer of one vocabulary file: ``words`` takes a text apart, ``merge`` encodes a word."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self._tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._find = regex.compile(pattern).findall
        plain = pattern.replace(r"\s", r"\t-\r \x85\xa0").replace(r"\p{L}", _common("L")).replace(r"\p{N}", _common("N"))
        self._find_common = re.compile(plain).findall
        special = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self._specials = re.compile(f"({special or '(?!)'})").split
        letters = byte_letters()
        self._inner = [vocab[c] for c in letters]
        self._last = [vocab[c + end] for c in letters]
        self._ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(model["merges"])}
        self._made = [vocab[a + b] for a, b in model["merges"]]

    def _plain(self, part: str) -> list[str]:
        if part.isascii():
            return self._find_common(part.lower())
        if _BEYOND(part):
            return self._find(_NEWEST.normalize_str(part))
        return self._find_common(unicodedata.normalize("NFC", part).lower())

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own, as it stands."""
        parts = self._specials(text)
        if len(parts) == 1:
            return self._plain(text)
        return [w for part in parts for w in ([part] if part in self.special else self._plain(part))]

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word: always the pair of lowest rank, the leftmost of equals."""
        data = word.encode()
        ids = [self._inner[b] for b in data]
        ids[-1] = self._last[data[-1]]
        return tuple(self._merge_short(ids) if len(ids) <= WORD_BYTES else self._merge_long(ids))

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank_of, made = self._ranks.get, self._made
        none = len(made)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            at = ranks.index(rank)
            ids[at:at + 2] = [made[rank]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place) and linked neighbours."""
        ranks, size = self._ranks, len(ids)
        after, ahead = list(range(1, size + 1)), list(range(-1, size - 1))
        waiting = [(ranks[pair], at) for at in range(size - 1) if (pair := (ids[at], ids[at + 1])) in ranks]
        heapq.heapify(waiting)
        while waiting:
            rank, at = heapq.heappop(waiting)
            right = after[at]
            if right >= size or ids[at] < 0 or ranks.get((ids[at], ids[right])) != rank:
                continue
            ids[at], ids[right] = self._made[rank], -1
            after[at] = right = after[right]
            left = ahead[at]
            if right < size:
                ahead[right] = at
                if (pair := (ids[at], ids[right])) in ranks:
                    heapq.heappush(waiting, (ranks[pair], at))
            if left >= 0 and (pair := (ids[left], ids[at])) in ranks:
                heapq.heappush(waiting, (ranks[pair], left))
        return [i for i in ids if i >= 0]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of every list joined by a space, as a file without a decoder has it."""
        tokens = self._tokens.take(ids.flatten())
        lists = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), tokens)
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


class Encoder(dict):
    """Ids by word: words of the lexicon are kept once met, others in a memory of bounded size."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon) -> None:
        self._bpe, self._lexicon = bpe, lexicon
        self._rare: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if word in self._bpe.special:
            return (self._bpe.special[word],)
        ids = self._rare.get(word)
        if ids is None:
            ids = self._lexicon.get(word.encode())
            if ids is not None:
                self[word] = ids
                return ids
            ids = self._bpe.merge(word)
            if len(word) <= WORD_BYTES:
                if len(self._rare) >= MEMO_ENTRIES:
                    self._rare.clear()
                self._rare[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self._bpe.words(text))))


_BPE: dict[bytes, WordBpe] = {}
_ENCODERS: dict[str, Encoder] = {}


def _bpe(file: bytes) -> WordBpe:
    """One tokenizer per worker and vocabulary."""
    if file not in _BPE:
        _BPE[file] = WordBpe(file)
    return _BPE[file]


def word_counts(docs: DataFrame, file: bytes, text: str = "text") -> DataFrame:
    """(word, n) over all documents, for words of up to WORD_BYTES bytes."""
    shipped = docs.sparkSession.sparkContext.broadcast(file)  # one vocabulary file, a few megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shipped.value)
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            short = {w: n for w, n in held.items() if len(w) <= WORD_BYTES and w not in bpe.special}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(short.keys(), pa.string()), pa.array(short.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches, "text"):
            for value in batch.column("text").to_pylist():
                if value:
                    held.update(bpe.words(value))
            if len(held) >= MEMO_ENTRIES:
                yield out()
        yield out()

    plain = docs.select(F.col(_quoted(text)).cast("string").alias("text"))
    return plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def build_lexicon(docs: DataFrame, file: bytes, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the ``words`` most frequent words and hand the file to all machines; returns its name.

    It is written beside the checkpoints, from where Spark fetches it for every executor,
    also for those that join later.
    """
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast(file)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shipped.value)
        for batch in batches:
            ids = [bpe.merge(word) for word in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    frequent = word_counts(docs, file, text).orderBy(F.desc("n"), "word").limit(words).select("word")
    encoded = durable(frequent.mapInArrow(merged, "word string, ids array<int>"))
    block = compile_words({row["word"].encode(): tuple(row["ids"]) for row in encoded.toLocalIterator()})
    name = f"lexicon-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir(), name)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(block))
    out.close()
    sc.addFile(path.toString())
    return name


def round_trip(docs: DataFrame, file: bytes, text: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """The documents with ``token_ids`` and ``decoded``, the text that the library decodes from them."""
    name = build_lexicon(docs, file, text, lexicon_words)
    columns = [c for c in docs.columns if c.lower() not in OUTPUTS]
    # Inside, columns go by place, so that no name can clash or need quoting.
    places = [f"c{i}" for i in range(len(columns))]
    given = docs.select(*map(_quoted, columns), F.col(_quoted(text)).cast("string")).toDF(*places, "text")
    shipped = docs.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(_bpe(shipped.value), Lexicon(SparkFiles.get(name)))
        encoder, bpe = _ENCODERS[name], _bpe(shipped.value)
        for batch in slices(batches):
            found = [np.array(encoder.encode(value) if value else [], np.int32) for value in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in places), ids, bpe.decode(ids)], names=[*places, *OUTPUTS])

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema if f.name in places)
    return given.mapInArrow(run, f"{schema}token_ids array<int>, decoded string").toDF(*columns, *OUTPUTS)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(VOCABULARY_FILE), "rb") as f:
        file = f.read()
    found = round_trip(documents(spark, sf_dir, "doc_id", "text"), file)
    return found.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op12_word_bpe": op12_word_bpe}
# Normalisation and merges are beyond SQL; the tests hold the query against the tokenizer library.
ORACLES: dict[str, str] = {}
