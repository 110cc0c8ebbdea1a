"""Prefix trie, BPE with word ends and centroid clusters against brute force or the library."""

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import centroids, lexicon, prefix_trie, word_bpe


def _conversations():
    rnd = random.Random(3)
    turns = [(r, t) for r in ("user", "assistant", None) for t in ("", "a", "bb", "ccc", None, "é" * 7)]
    rows = []
    for c in [*range(0, 60), *range(100, 190), 305, 512]:
        row = [(i, *rnd.choice(turns[:6 if c % 2 else 18])) for i in range(rnd.randint(1, 5))]
        rows += [(c, *t) for t in row]
    rows += [(c, i, "user", t) for c in range(200, 280) for i, t in enumerate(["x", "y", "z"])]  # copies over many shards
    rows += [(290, i, "user", "x") for i in range(400)] + [(291, i, "user", "x") for i in range(300)]  # long ones
    rows += [(292, None, "user", "none"), (292, 1, "user", "x"), (None, 1, "user", "lost"), (293, 2, "b", "tie"), (293, 2, "a", "tie")]
    return [(*r, "clash", 1) for r in rows]


def _rebuilt(rows, shared):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    lists = {c: [(role, text) for _, role, _, text in sorted(found)] for c, found in own.items()}
    if not shared:
        return lists
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in lists}
    return {c: lists.get(c - c % 100, [])[:heads[c]] + lists[c][heads[c]:] for c in lists}


def _trie(lists):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = own + sum(saved[k] for k in kids[node])
    return sorted((
        min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n],
        hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("shard_turns", [10, 100_000])
def test_prefix_trie(spark, shared, shard_turns):
    rows = _conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string, `depth.x` int").repartition(3)
    lists = prefix_trie.turn_lists(table)
    lists = prefix_trie.with_shared_heads(lists) if shared else lists
    found = prefix_trie.prefix_trie(lists, shard_turns).fillna({"parent_conv_id": -1}).collect()
    assert sorted(tuple(r) for r in found) == _trie(_rebuilt(rows, shared))


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(prefix_trie.turn_lists(none))).collect() == []


def test_paths_name_a_prefix_by_its_first_and_last_splitter():
    keys = [((1, 2, 3), 0), ((1, 2, 3), 5), ((1, 2, 4), 0), ((2,), 0)]
    first, last = prefix_trie.paths(keys)
    assert first == [[0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 2], [0, 3]]
    assert last == [[3, 2, 2, 1], [3, 2, 2, 1], [3, 2, 2, 2], [3, 3]]


def test_ternary_tree_keeps_long_lists_without_recursion():
    tree = prefix_trie.TernaryTree()
    assert tree.add_balanced([((1,) * 5000, (1,) * 5000), ((1, 2), (1, 1))]) == [5001 if tree.label[1] != 1 else n for n in (5001, 2)] or len(tree.label) == 5002


_ODD = ["a", "B", "é", "é", "Σ", "ς", "İ", "ß", "ẞ", "日", "本", "1", "٣", "½", " ", "\n", "\x1c", "\x85", " ", "​", "'s", "'LL", "'",
        "<|endoftext|>", "<|startoftext|>", "<", "|>", "_", "😀", "̀", "﻿", "ﬁ", "Å", "ᄒ", "ᅡ", "Ǆ", "Ⱥ", "Ᲊ", "Ž"]


def _texts():
    rnd = random.Random(9)
    odd = ["".join(rnd.choice(_ODD) for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    plain = [" ".join(rnd.choice(["The", "eating", "houses,", "don't", "é", "42nd", "x" * 9]) for _ in range(rnd.randint(1, 80))) for _ in range(60)]
    return [None, "", " ", *odd, *plain, plain[0], plain[0], "abc" * 700, "word " * 30_000, "é" * 333]


def test_word_bpe_equals_the_library(spark):
    rows = [(i if i % 7 else None, t, "old", 1) for i, t in enumerate(_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Decoded string, `a.b` int").repartition(3)
    with open(public_tokenizers.path(word_bpe.VOCABULARY_FILE), "rb") as f:
        file = f.read()
    found = word_bpe.round_trip(docs, file, lexicon_words=50)
    assert found.columns == ["doc_id", "text", "a.b", "token_ids", "decoded"]
    library = Tokenizer.from_file(public_tokenizers.path(word_bpe.VOCABULARY_FILE))
    for row in found.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["token_ids"] == ids, row["text"][:100]
        assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert found.count() == len(rows)
    assert word_bpe.round_trip(docs.limit(0), file).collect() == []


def test_word_counts_cover_all_documents(spark):
    docs = spark.createDataFrame([("Aa bb, aa",), ("aa <|endoftext|>",), (None,), ("y" * 100,)], "text string")
    with open(public_tokenizers.path(word_bpe.VOCABULARY_FILE), "rb") as f:
        counts = {r["word"]: r["n"] for r in word_bpe.word_counts(docs, f.read()).collect()}
    assert counts == {"aa": 3, "bb": 1, ",": 1}


def test_short_and_long_merges_agree():
    with open(public_tokenizers.path(word_bpe.VOCABULARY_FILE), "rb") as f:
        bpe = word_bpe.WordBpe(f.read())
    rnd = random.Random(1)
    for _ in range(500):
        word = "".join(rnd.choice(["in", "th", "e", "ing", "a", "é", "x"]) for _ in range(rnd.randint(1, 20)))
        start = [bpe._inner[b] for b in word.encode()]
        assert bpe._merge_short(list(start)) == bpe._merge_long(list(start))


def test_lexicon_shares_suffixes_and_keeps_every_word(tmp_path):
    words = {w.encode(): tuple(range(i, i + i % 4 + 1)) for i, w in enumerate(["eating", "heating", "seating", "eat", "eats", "é", "a", "ab" * 30])}
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compile_words(words))
    found = lexicon.Lexicon(str(path))
    assert {w: found.get(w) for w in words} == words
    assert [found.get(w) for w in (b"", b"ea", b"eatin", b"eatingx", b"zz")] == [None] * 5
    assert found.states < sum(map(len, words))
    path.write_bytes(lexicon.compile_words({}))
    assert lexicon.Lexicon(str(path)).get(b"a") is None


def _lloyd(vectors, k, rounds, scale=256):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in vectors
            if v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    clamp = 1 << 27
    kept = [(i, [max(-clamp, min(clamp, x)) for x in v]) for i, v in kept]
    named = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[n])] if groups[n] else c for n, c in enumerate(centres)]
    return [(i, n, d) for i, v in kept for d, n in [nearest(v)]], centres


@pytest.mark.parametrize("large", [False, True])
def test_clusters(spark, large):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(i % 5, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(i, [1.0] * 6) for i in range(300, 340)] + [(7, [2.0] * 6), (7, [2.0] * 6), (None, [0.5] * 6)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 5 + [None]), (904, [float("nan")] * 6), (905, [float("inf")] * 6)]
    if large:
        rows += [(910, [3e5, -3e5, 0.0, 1.0, 2.0, 3.0]), (911, [1e30] * 6)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, chunk string").repartition(3)
    found, centres = centroids.cluster(table, k=12, rounds=4, dimensions=6, shard_columns=4, chunk_rows=50)
    want, want_centres = _lloyd(rows, 12, 4)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert centres.tolist() == want_centres


def test_clusters_of_few_vectors(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    found, centres = centroids.cluster(table, k=40, dimensions=2)
    assert sorted((r["vec_id"], r["distance"]) for r in found.collect()) == [(1, 0), (2, 0)]
    assert len(centres) == 2
    found, centres = centroids.cluster(table.filter(F.lit(False)), dimensions=2)
    assert found.collect() == [] and len(centres) == 0


def test_queries_and_their_sql_name_the_same_operators():
    from factloom.llm import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert json.dumps(sorted(catalog.queries()))
