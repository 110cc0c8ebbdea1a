"""Each operator against brute force or a library, on texts with nulls, ties and repeats."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factloom.llm import (
    byte_bpe,
    fingerprints,
    jaccard_join,
    language_id,
    mixing,
    perplexity,
    places,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    token_counts,
)

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_words", StringType()), StructField("slot", StringType()),
])


def _texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["an", "er", "tion", "é", "st", "ou", "le"]) for _ in range(rnd.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    base = [" ".join(word() for _ in range(rnd.randint(1, 160))) + "." for _ in range(24)]
    out = [None, "", " \n\t ", "one", "a b c", "x " * 400, *base]
    out += [base[7], base[7], base[8] + " tail", "Head\n" + base[9]]
    out += [f"{base[10]} {passage} {base[11]}", f"{passage}\n{base[12]}", f"{base[13]} {passage}"]
    near = base[14].split() + passage.split()
    out += [" ".join(near), " ".join([*near[:-1], "other"]), " ".join(near).upper(), " ".join(near * 300)]
    return out


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    found = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None, "a")[i % 4], "clash", "clash") for i, t in enumerate(texts)]
    # A row without an id, and one row three times.
    return [*found, (None, texts[20], "en", "a", "clash", "clash"), *[(900, texts[21], "fr", "b", "clash", "clash")] * 3]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(found):
    return sorted((tuple(r) for r in found), key=repr)


def _covered(units, size, _rows):
    seen = Counter(tuple(u[i:i + size]) for u in units for i in range(len(u) - size + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            if seen[tuple(u[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append(gone)
    return out


def test_substring_dedup(docs, none, rows):
    units = [(t or "").encode().split() for _, t, *_ in rows]
    want = [
        (r[0], len(u), b" ".join(w for w, x in zip(u, g, strict=True) if not x).decode())
        for r, u, g in zip(rows, units, _covered(units, 35, rows), strict=True)]
    found = substring_dedup.remove_repeats(docs)
    assert "clash" not in [r.n_words for r in found.collect()]
    assert _sorted(found.select("doc_id", "n_words", "kept_text").collect()) == sorted(want, key=repr)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_rows_of_one_id_are_told_apart(spark):
    """Among 400,000 rows of one id and different texts no two keys are equal (31 bits: some 37 pairs)."""
    docs = spark.range(400_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    keys = places.keyed(docs, "doc_id", "text", 64)
    assert keys.select("_id", "_check").distinct().count() == 400_000
    assert keys.filter("_check >= 0").count() == 0
    some = keys.limit(1000).union(places.keyed(docs.withColumn("doc_id", F.lit(-7).cast("long")), "doc_id", "text", 64).limit(1000)).collect()
    ids, checks = (np.array([r[c] for r in some], np.int64) for c in ("_id", "_check"))
    assert places.group_of(ids, checks, 64).tolist() == [r._group for r in some]


def test_chunks_split_one_id(spark):
    """Texts without an id are dealt to several chunks."""
    docs = spark.range(2000).select(F.lit(0).cast("long").alias("_key"), F.lit("-:en").alias("_lang"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    dealt, trusted = perplexity._in_chunks(docs, spark.createDataFrame([(0,)], "_key long"))
    sizes = [r["count"] for r in dealt.groupBy("_chunk").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1000
    assert trusted.count() == len(sizes)


def test_substring_dedup_keeps_layout(docs):
    text = {r.doc_id: (r.text, r.kept_text) for r in substring_dedup.remove_repeats(docs, keep_layout=True).collect()}
    assert text[4] == ("a b c", "a b c") and text[2][1] == " \n\t "


@pytest.mark.parametrize("common", [False, True])
def test_suffix_dedup(docs, none, rows, common, monkeypatch):
    if common:  # every leading string is dealt over all buckets
        monkeypatch.setattr(suffix_dedup.Ranges, "is_common", lambda self, lead: lead == lead)
    units = [(t or "").encode() for _, t, *_ in rows]
    want = []
    for r, u, g in zip(rows, units, _covered(units, 200, rows), strict=True):
        spans = sum(1 for k, _ in itertools.groupby(g) if k)
        want.append((r[0], len(u), spans, bytes(b for b, x in zip(u, g, strict=True) if not x)))
    found = suffix_dedup.remove_repeated_bytes(docs)
    got = [(r.doc_id, r.n_bytes, len(r.removed_spans), bytes(r.kept)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


def _components(rows, words, percent):
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(fold).split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    name = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            name = [name[a] if x == name[b] else x for x in name]
    low = {c: min((rows[i][0] for i in range(len(rows)) if name[i] == c and rows[i][0] is not None), default=None) for c in name}
    return sets, name, low


def test_jaccard_join(docs, none, rows, monkeypatch):
    sets, name, low = _components(rows, 4, 85)
    want = [(r[0], len(s), low[c]) for r, s, c in zip(rows, sets, name, strict=True)]
    own = F.when(F.col("_check") >= 0, F.col("_id"))
    assert _sorted(jaccard_join.linked(docs, 4, 85).select(own, "n_shingles", "component_id").collect()) == sorted(want, key=repr)
    assert jaccard_join.linked(none).count() == 0


def test_one_of_each(docs, rows):
    _, name, _ = _components(rows, 5, 80)
    empty = {r[0] for r in rows if not (r[1] or "").split()}
    kept = jaccard_join.one_of_each(docs).collect()
    assert len(kept) == len({c for c, r in zip(name, rows, strict=True) if r[0] not in empty}) + len(empty)
    assert kept[0].asDict().keys() == set(docs.columns)


def test_byte_bpe(docs, none, rows):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    file = byte_bpe.read_ranks(P.path(byte_bpe.RANKS_FILE))
    ranks = byte_bpe.encoder(file, P.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    found = [(r.doc_id, r.token_ids, bytes(r.decoded)) for r in byte_bpe.round_trip(docs, file).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert byte_bpe.round_trip(none, file).count() == 0
    rnd = random.Random(3)
    encode = byte_bpe.encoder(file, P.PATTERN).encode
    for _ in range(300):
        text = "".join(chr(rnd.choice([rnd.randint(1, 0x2FF), rnd.randint(0x3040, 0x9FFF), 0x1F600, 32, 10, 97, 101])) for _ in range(40))
        assert encode(text) == library.encode_ordinary(text)
    assert encode("ab" * 4000) == library.encode_ordinary("ab" * 4000)


def test_token_counts(docs, none, rows):
    models = pytest.importorskip("tokenizers").models
    import public_tokenizers as P
    from tokenizers import Tokenizer

    pieces, fallback = token_counts.read_pieces(P.path(token_counts.PIECES_FILE))
    low = min(s for _, s in pieces)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *[(f"<0x{i:02X}>", low) for i in range(256)], *pieces], 0, fallback))
    want = [(r[0], len(library.encode("▁" + r[1].replace(" ", "▁")).ids) if r[1] else 0) for r in rows]
    found = token_counts.token_counts(docs, pieces, fallback).select("doc_id", "n_tokens").collect()
    assert _sorted(found) == sorted(want, key=repr)
    assert token_counts.token_counts(none, pieces, fallback).count() == 0


def test_token_count_ties():
    # Equal scores: the longer piece; without byte pieces a run of unknowns is one token.
    assert token_counts.Counter([("▁a", -2.0), ("▁", -1.0), ("a", -1.0)], False).text("a") == (1, -2.0)
    assert token_counts.Counter([("▁", -1.0)], False).text("xyz")[0] == 2
    assert token_counts.Counter([("▁", -1.0)], True).text("éé")[0] == 5



def _slow_count(pieces, fallback, word):
    scores, low = dict(pieces), min((s for _, s in pieces), default=0.0) - token_counts.UNKNOWN_PENALTY
    best = [(0.0, 0, False)]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(end):
            if word[start:end] in scores and (top is None or best[start][0] + scores[word[start:end]] > top[0]):
                top = best[start][0] + scores[word[start:end]], best[start][1] + 1, False
        score, n, odd = best[end - 1]
        if word[end - 1] not in scores and (top is None or score + low > top[0]):
            top = score + low, n + (len(word[end - 1].encode()) if fallback else int(not odd)), True
        best.append(top)
    return best[-1][1], best[-1][0]


def test_token_counts_in_one_pass():
    """Pieces are taken as the automaton lists them: equal to every split, ties included,
    and without a list and a sort for each place of a word."""
    import sys

    rng = random.Random(8)
    for _ in range(300):
        pieces = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -float(rng.randint(1, 6)) for _ in range(rng.randint(1, 9))}
        word, fallback = "".join(rng.choices("abcdé", k=rng.randint(1, 12))), rng.random() < 0.5
        pieces = list(pieces.items())
        assert token_counts.Counter(pieces, fallback).word(word) == _slow_count(pieces, fallback, word)
    counter, calls = token_counts.Counter([("a", -1.0), ("aa", -1.5), ("aaa", -2.0)], True), [0]
    sys.setprofile(lambda frame, event, arg: calls.__setitem__(0, calls[0] + (event in ("call", "c_call"))))
    counter.word("a" * 1000)
    sys.setprofile(None)
    assert calls[0] < 100


def test_quality_rules(docs, none):
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert found[0].n_words == 0 and found[0].base_failed and not found[0].kept
    assert found[5].n_repeat_words == 400 and found[5].base_failed
    assert quality_rules.quality_rules(none).count() == 0
    for line, fails in (("A sentence that ends.", False), ("no end", True), ("a | b | c | d.", True), ("Please accept cookies now.", True), ("ALL OF THIS IS LOUD.", True)):
        assert quality_rules.line_fails(line) is fails


def test_mixing_deviation(spark, none):
    sizes = {"a": 900, "b": 130, "c": 410, None: 77}
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))], "doc_id long, source string")
    weights = {"a": 5, "b": 3}
    found = sorted(mixing.mix(docs, weights, 2, block_rows=10).collect(), key=lambda r: r.position)
    assert [r.position for r in found] == list(range(len(found))) and len({r.doc_id for r in found}) == len(found)
    slots = [next(iter(g)).source for _, g in itertools.groupby(found, key=lambda r: r.slot)]
    left = {s: -(-n // 10) for s, n in sizes.items()}
    weight = {s: weights.get(s, 2) for s in sizes}
    taken, start = Counter(), 0
    for t, s in enumerate(slots, 1):
        taken[s] += 1
        left[s] -= 1
        total = sum(w for k, w in weight.items() if left[k] + taken[k] > 0)
        live = [k for k in weight if left[k] + taken[k] > 0]
        assert all(abs(taken[k] - (t - start) * weight[k] / total) < 1 for k in live)
        if left[s] == 0:
            taken, start = Counter(), t
            weight = {k: w for k, w in weight.items() if left[k]}
    assert mixing.mix(none.select("doc_id", "source")).count() == 0


def test_mixing_keeps_rows(docs, rows):
    assert mixing.in_order(mixing.mix(docs)).count() == len(rows)


def test_fingerprints(docs, none, rows):
    found = fingerprints.with_edits(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in ordered]
    want = []
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        want.append((ordered[i][0], len(t), t[:len(t) - half] + after[:half]))
    assert sorted([(r.doc_id, r.n_chars, r.edited) for r in found], key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    same = {r.fingerprint for r in found if r.doc_id == 900}
    assert len(same) == 1
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def sketch(text):
        words = text.encode().translate(fold).split()
        marks = set()
        for i in range(max(1, len(words) - 4)) if words else ():
            h = 42
            for w in words[i:i + 5]:
                h = xxhash.xxh64_intdigest(w, h)
            marks.add(f"{h:016x}")
        return sorted(h for h in marks if h < "2" or h == min(marks))

    def near(a, b):
        return 1.0 if a == b else len({*a} & {*b}) / min(len(a), len(b)) if a and b else 0.0

    marks = []
    for i, (doc_id, n, edited) in enumerate(want):
        mine, other, after = sketch(texts[i]), sketch(edited), sketch(texts[(i + 1) % len(texts)])
        marks.append((doc_id, "".join(mine), "".join(other), near(mine, other), near(mine, after)))
    got = [(r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in found]
    assert sorted(got, key=repr) == sorted(marks, key=repr)
    assert fingerprints.with_edits(none).count() == 0


def test_fingerprints_merge(spark):
    both = spark.createDataFrame([("alpha beta gamma delta epsilon zeta", "beta gamma delta epsilon zeta eta theta")], "x string, y string")
    f = fingerprints.fingerprint(fingerprints.fingerprint(both, "x", "a"), "y", "b")
    f = f.select("a", "b", fingerprints.merged(F.col("a"), F.col("b")).alias("m")).first()
    assert f.m[:16] == min(f.a[:16], f.b[:16])


def test_language_id(spark, none):
    rnd = random.Random(1)
    pools = {"en": ["the", "and", "thing", "where"], "fr": ["le", "être", "où", "façon"]}
    rows = [(i, " ".join(rnd.choices(pools[lang], k=rnd.randint(3, 30))), lang) for i in range(400) for lang in [("en", "fr")[i % 2]]]
    docs = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 34", "en"), (1002, "the thing", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows) and found[1002].lang_pred == "en"
    assert [(found[i].lang_pred, found[i].score) for i in (1000, 1001)] == [("und", 0.0)] * 2
    empty = language_id.fit(none)
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_language_id_copies(spark):
    """A language of many copies has centroids, and no group of copies enters the sample as a whole."""
    row_share = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    texts = spark.range(40).select(F.concat(F.lit("où être "), F.col("id").cast("string"), F.lit(" façon")).alias("text"))
    texts = texts.filter(row_share > 0.2).limit(5)
    few = texts.crossJoin(spark.range(1000)).select("text", F.lit("fr").alias("lang"))  # by rows the share is 0.08
    many = spark.range(3000).select(F.concat(F.lit("the thing "), F.when(F.col("id") < 2000, F.col("id")).otherwise(7).cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows = few.union(many)
    langs = Counter(r.lang for r in language_id.sample(rows, {"fr": 5, "en": 2000}).collect())
    assert langs["fr"] == 5 and 320 < langs["en"] < 480
    model = language_id.fit(rows)
    assert set(model[1]) == {"en", "fr"}
    assert {r.lang_pred for r in language_id.predict(texts, model).collect()} == {"fr"}


def test_quality_classifier(spark, docs, none):
    rnd = random.Random(2)
    clean = [(i, " ".join(rnd.choices(["the", "and", "river", "stone", "walks"], k=40)), "en") for i in range(440)]
    junk = [(500 + i, " ".join("".join(rnd.choices("#$%&XYZQ", k=6)) for _ in range(40)), "en") for i in range(20)]
    rows = spark.createDataFrame([*clean, *junk, (600, None, "en"), (601, "", None)], "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(400)], "doc_id long")
    found = {r.doc_id: r for r in perplexity.classify(rows, trusted, quantile=1.0).collect()}
    assert sum(found[i].keep for i in range(440)) >= 400
    assert not any(found[i].keep for i in [*range(500, 520), 600, 601])
    assert perplexity.classify(docs, trusted.limit(0)).filter("NOT keep").filter("n_bytes > 0").count() == 0
    assert perplexity.classify(none, trusted).count() == 0


def test_quality_classifier_of_few_trusted(spark):
    """Languages of 1, 5 and 20 trusted rows keep equally clean documents; junk goes where a model can tell."""
    rnd = random.Random(3)
    rows, trusted, n = [], [], 0
    for lang, k in (("one", 1), ("five", 5), ("twenty", 20), ("none", 0), ("many", 300)):
        words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)]
        for i in range(max(60, k + 30)):
            rows.append((n, " ".join(rnd.choices(words, k=40)), lang, True))
            trusted += [(n,)] if i < k else []
            n += 1
        for _ in range(10):
            rows.append((n, " ".join("".join(rnd.choices("#$%&XYZQ", k=6)) for _ in range(40)), lang, False))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, clean boolean")
    found = perplexity.classify(docs, spark.createDataFrame(trusted, "doc_id long")).collect()
    assert len(found) == len(rows)
    kept = Counter((r.lang, r.clean) for r in found if r.keep)
    assert [kept[lang, True] for lang in ("one", "five", "twenty", "none")] == [60] * 4
    assert kept["many", True] >= 325 and kept["many", False] == 0
    assert kept["five", False] == kept["twenty", False] == 0 and kept["none", False] == 10
    assert {r.lang for r in found if r.threshold is None} == {"none"}


def test_perplexity_against_brute_force(spark):
    """Every probability of a small model, by the formulas of interpolated modified Kneser-Ney."""
    text = b"\n" * 4 + b"abracadabra abracadabra cab"
    order = perplexity.ORDER
    grams = Counter(text[i:i + order] for i in range(len(text) - order + 1))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def discount(n, c):
        of = Counter(levels[n].values())
        k = min(c, 3)
        if of[1] and of[k]:
            y = of[1] / (of[1] + 2 * of[2])
            return max(0.1, min(k, k - (k + 1) * y * of[k + 1] / of[k]))
        return k / 2

    def p(n, g):
        if n == 0:
            return 1 / 256
        mine = {x: c for x, c in levels[n].items() if x[:-1] == g[:-1]}
        total = sum(mine.values())
        if not total:
            return p(n - 1, g[1:])
        cut = {x: min(c, discount(n, c)) for x, c in mine.items()}
        return (mine.get(g, 0) - cut.get(g, 0)) / total + sum(cut.values()) / total * p(n - 1, g[1:])

    asked = [*grams, b"xbrac", b"abrax", b"\n\n\n\nz"]
    rows = [("en", int.from_bytes(g), grams.get(g, 0)) for g in asked]
    table = spark.createDataFrame(rows, "_lang string, _gram long, _n long")
    logs = {r._gram: r._log for r in perplexity._probabilities(table.select("_lang", "_gram"), table.filter("_n > 0")).collect()}
    import math

    for g in asked:
        assert logs[int.from_bytes(g)] == pytest.approx(math.log(p(order, g)), abs=1e-9)


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(found) <= docs.count() and len({r.doc_id for r in found}) == len(found)
    assert all(len(r.token_ids) == r.n_tokens and len(r.text) == r.n_chars for r in found)


def test_pipeline_is_mixed(spark):
    """On the rows of run() every source is less than one block away from its share."""
    import corpus_pipeline

    found = sorted(corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.position)
    assert [r.position for r in found] == list(range(len(found)))
    blocks = [(slot, [r.source for r in g]) for slot, g in itertools.groupby(found, key=lambda r: r.slot)]
    assert [slot for slot, _ in blocks] == list(range(len(blocks))) and all(len(set(b)) == 1 for _, b in blocks)
    left = Counter(b[0] for _, b in blocks)
    assert len(left) > 1 and all(n == -(-sum(r.source == s for r in found) // mixing.BLOCK_ROWS) for s, n in left.items())
    taken, start = Counter(), 0
    live = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in left}
    for t, (_, block) in enumerate(blocks, 1):
        taken[block[0]] += 1
        assert all(abs(taken[s] - (t - start) * w / sum(live.values())) < 1 for s, w in live.items())
        left[block[0]] -= 1
        if not left[block[0]]:
            taken, start = Counter(), t
            live = {s: w for s, w in live.items() if left[s]}
