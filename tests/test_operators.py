"""Small cases for rules that the derived data does not reach."""

from pyspark.sql import functions as F

from factloom.functions import skew
from factloom.functions import typeexpr as X
from factloom.operators import calls as C
from factloom.operators import lookup as L
from factloom.operators import resolve as R
from factloom.operators import search as S
from factloom.operators import snapshots
from factloom.plans import extensions
from factloom.sources.corpus import corpus_scan


def test_resolution_order(spark):
    types = spark.createDataFrame(
        [("::A::B::Call", "class"), ("::B::Call", "class"), ("::Z::call", "class"), ("::Lone", "module"), ("::X::Lone2", "class")], "name string, kind string"
    )
    names = ["Call", "B::Call", "::B::Call", "::Call", "A::B::Call", "Lone", "Lone2", "Y::Lone2", "call", "None"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: (r.resolved, r.is_ambiguous, r.is_guessed) for r in R.resolve_types(df, R.type_index(types)).collect()}
    assert got == {
        "Call": ("::A::B::Call", True, True), "B::Call": ("::B::Call", False, False), "::B::Call": ("::B::Call", False, False),
        "::Call": (None, True, True), "A::B::Call": ("::A::B::Call", False, False), "Lone": ("::Lone", False, False),
        "Lone2": ("::X::Lone2", False, False), "Y::Lone2": (None, False, True), "call": ("::Z::call", False, False), "None": (None, False, False),
    }


def test_type_algebra(spark):
    df = spark.createDataFrame([(["B", "nil", "A | B"],), (["Array", "Array[Unknown]"],), ([],), (["Array[A | Hash[B]] | nil"],)], "t array<string>")
    assert [r[0] for r in df.select(X.union_types("t")).collect()] == ["A | B | nil", "Array[Unknown]", "Unknown", "Array[A | Hash[B]] | nil"]


def test_bucketed_windows_equal_plain_ones(spark):
    rows = [(k, i, (i * 7 + k) % 5) for k in range(3) for i in range(100 * (k + 1))]
    df = spark.createDataFrame(rows, "k int, i int, v int")
    bucket = F.floor(F.col("i") / 16)
    sums = {(r.k, r.i): r.s for r in skew.running_sum(df, ["k"], bucket, [F.col("i")], F.col("v"), "s").collect()}
    tops = {(r.k, r.i): r.m for r in skew.running_max(df, ["k"], bucket, [F.col("i")], F.col("v"), "m").collect()}
    lags = {(r.k, r.i): r.p_v for r in skew.previous_row(df, ["k"], bucket, [F.col("i")], ["v"], "p_").collect()}
    odd = F.when(F.col("v") > 2, F.col("i"))
    lasts = {(r.k, r.i): r.l for r in skew.last_value_before(df, ["k"], bucket, [F.col("i")], odd, "l").collect()}
    for k in range(3):
        total, top, before, last = 0, -1, None, None
        for _, i, v in sorted(r for r in rows if r[0] == k):
            total, top = total + v, max(top, v)
            last = i if v > 2 else last
            assert (sums[k, i], tops[k, i], lags[k, i], lasts[k, i]) == (total, top, before, last)
            before = v


def test_top_k_of_a_hot_key(spark):
    df = spark.range(5000).selectExpr("'hot' k", "id", "(id * 37) % 5000 v")
    got = [r.v for r in skew.top_k(df, ["k"], [F.col("v")], 10).orderBy("rank").collect()]
    assert got == list(range(10))


def test_search_equals_scan(spark):
    names = ["User", "UserName", "::Admin::User", "use_case", "reuse", "Other", "us"]
    declarations = spark.createDataFrame([("class", None, n, "u", i, 0) for i, n in enumerate(names)], "kind string, owner string, name string, uri string, line long, col long")
    for text in ["user", "US", "e", "use", "zzz"]:
        q = spark.createDataFrame([(text, text)], "qid string, text string")
        simple = {n: n.split("::")[-1].lower() for n in names}
        want = sorted((n for n in names if text.lower() in simple[n]), key=lambda n: (simple[n] != text.lower(), n))
        assert [r.name for r in S.workspace_search(q, declarations).orderBy("rank").collect()] == want


def test_latest_versions_follow_arrival(spark):
    rows = [
        ("a", 1, "disk", None, None, 1), ("a", 2, "buffer", 1, 5, None), ("a", 3, "disk", None, None, 9), ("a", 4, "buffer", 1, 4, None),
        ("b", 1, "buffer", 1, 9, None), ("b", 2, "buffer", 2, 1, None), ("b", 3, "buffer", 1, 3, None), ("b", 4, "buffer", 1, 2, None),
        ("c", 1, "buffer", 1, 9, None), ("c", 2, "buffer", 1, None, None), ("c", 3, "buffer", 1, 2, None),
        ("d", 1, "disk", None, None, 7), ("d", 2, "disk", None, None, 3),
    ]
    df = spark.createDataFrame(rows, "uri string, arrival long, source string, buffer_id long, document_version long, read_sequence long")
    assert {r.uri: r.arrival for r in snapshots.latest_versions(df).collect()} == {"a": 2, "b": 3, "c": 3, "d": 1}


def test_incomplete_scan_removes_nothing(spark):
    facts = spark.createDataFrame([("a",), ("b",)], "uri string")
    seen = spark.createDataFrame([("a",)], "uri string")
    for complete, kept in ((True, 1), (False, 2)):
        gate = spark.createDataFrame([(complete,)], "complete boolean")
        assert snapshots.sweep(facts, seen, gate).count() == kept


def test_corpus_scan(spark, tmp_path):
    for path in ["app/a.rb", "vendor/x.rb", "public/assets/y.rb", "lib/tmp/z.rb", "lib/t.rake", "lib/n.txt"]:
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x = 1\n")
    assert {r.path for r in corpus_scan(spark, str(tmp_path)).collect()} == {"app/a.rb", "lib/t.rake"}


def test_own_rules_join_the_built_in_ones(spark):
    extensions.clear()
    extensions.register_rules(spark.createDataFrame([("Maybe", "value", False, False, False, "T | nil"), ("Array", "map", False, False, False, "nil")], C.rule_table(spark).schema))
    rules = extensions.rules_with_plugins(C.rule_table(spark))
    calls = spark.createDataFrame([("Maybe[User]", "value", None, False, None), ("Array[User]", "map", None, True, "Post")], "receiver_type string, name string, first_arg string, has_block boolean, block_type string")
    assert {r.name: r.return_type for r in C.apply_generic_rules(calls, rules).collect()} == {"value": "User | nil", "map": "Array[Post]"}
    extensions.clear()


def test_union_members_at_any_depth_and_length(spark):
    deep = "A[B | C[D[E[F[G | H]]]]] | Z"
    wide = " | ".join(f"T{i}" for i in range(10_000))
    from factloom.functions import typeexpr

    rows = spark.createDataFrame([(deep,), (wide,), (None,)], "t string").select(typeexpr.union_members("t").alias("m")).collect()
    assert rows[0].m == ["A[B | C[D[E[F[G | H]]]]]", "Z"]
    assert len(rows[1].m) == 10_000 and rows[2].m is None


def test_inputs_fingerprint_has_one_scheme_for_all_sizes(spark):
    from pyspark.sql import functions as F

    from factloom.operators import snapshots

    files = spark.range(4097).select(F.lit("g").alias("g"), F.concat(F.lit("p"), "id").alias("path"), F.col("id").alias("mtime"), F.col("id").alias("size"))
    whole = snapshots.inputs_fingerprint(files, "g").first()
    again = snapshots.inputs_fingerprint(files.repartition(7), "g").first()
    fewer = snapshots.inputs_fingerprint(files.filter("id < 4096"), "g").first()
    assert whole == again and whole.n_files == 4097 and whole.fingerprint != fewer.fingerprint


def test_column_hides_association_of_one_name(spark):
    rows = [("::K", "owner", "model_association", False), ("::K", "owner", "model_column", False), ("::K", "owner", "signature", False)]
    got = L.merge_members(spark.createDataFrame(rows, "receiver string, name string, origin string, conditional boolean")).collect()
    assert [(r.name, r.origin, r.position) for r in got] == [("owner", "model_column", 1)]


def test_single_receiver_through_alias_is_certain(spark):
    asked = spark.createDataFrame([("::K", "aka"), ("::K | ::J", "aka")], "receiver_type string, name string")
    chain = spark.createDataFrame([("::K", 0, "::K", "instance_method", "self"), ("::J", 0, "::J", "instance_method", "self")], "owner string, pos int, name string, decl_side string, origin string")
    heads = spark.createDataFrame([("instance_method", "::K", "old", "public", "source")], "kind string, owner string, name string, visibility string, origin string")
    aliases = spark.createDataFrame([("u", "::K", "aka", "old", False, "public", 1)], "uri string, owner string, new_name string, old_name string, singleton boolean, visibility string, ordinal int")
    got = {r.receiver_type: (r.sym_name, r.conditional) for r in L.lookup_union(asked, chain, heads, aliases).collect()}
    assert got == {"::K": ("old", False), "::K | ::J": ("old", True)}


def test_lookup_expands_each_link_on_its_shorter_side(spark):
    names = [f"m{i}" for i in range(40)]
    chain = spark.createDataFrame(
        [(r, pos, n, "self", "instance_method") for r in ("::A", "::B") for pos, n in enumerate((r, "::Big", None))],
        "owner string, pos int, name string, origin string, decl_side string")
    heads = spark.createDataFrame(
        [("instance_method", "::Big", n) for n in names] + [("instance_method", "::A", "m1"), ("instance_method", "::B", "gone_alias")],
        "kind string, owner string, name string")
    aliases = spark.createDataFrame(
        [("::A", "also", "m1", False, 1), ("::B", "gone_alias", "nowhere", False, 1), ("::Big", "also", "m2", True, 1)],
        "owner string, new_name string, old_name string, singleton boolean, ordinal int")
    asked = [("::A", n) for n in ("m1", "also", "never")] + [("::B", n) for n in (*names, "gone_alias")] + [("::A", "m1")]
    found = L.lookup(spark.createDataFrame(asked, "receiver string, name string"), chain, heads, aliases)
    got = sorted((r.receiver, r.name, r.rank, r.sym_owner, r.sym_name) for r in found.collect())
    assert got == sorted(
        [("::A", "m1", 0, "::A", "m1"), ("::A", "m1", 1, "::Big", "m1"), ("::A", "also", 0, "::A", "m1")]
        + [("::B", n, 1, "::Big", n) for n in names])
