"""The findings ask only for what calls ask, and go over the calls once."""

from factloom.operators import hierarchy as H
from factloom.operators import rules as I

SMOKE = "/root/testdata/sf0.001"
FINDING = "uri string, line long, col long, code string, message string, severity string, confidence string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lines_of_some_types_are_those_of_all(spark):
    links = [(f"A{i}", f"A{i + 1}") for i in range(9)] + [("X", "Y"), ("Y", "Z"), ("Z", "X"), ("S", "S"), ("T", "X")]
    superclass = spark.createDataFrame(links, "node string, parent string")
    starts = spark.createDataFrame([("A0",), ("A7",), ("X",), ("S",), ("T",), ("A0",), (None,)], "node string")
    every = H.superclass_closure(superclass).join(starts.distinct(), "node", "left_semi").select("node", "dist", "anc")
    assert rows(H.superclass_lines(superclass, starts)) == rows(every)
    alone = spark.createDataFrame([("Q",)], "node string")
    assert rows(H.superclass_lines(superclass, alone)) == [("Q", 0, "Q")]


def test_findings_make_the_chains_that_calls_ask_for(spark):
    from factloom.plans.facts import Facts, forget_derived
    from factloom.plans.q_diagnose import findings
    from factloom.plans.q_hierarchy import chain
    from factloom.plans.q_lookup import asked_chain, asked_types

    forget_derived()
    f = Facts(spark, SMOKE)
    found = rows(findings(f))
    assert found and not f.has_derived("chain_i")
    asked = asked_chain(f)
    types = asked_types(f)
    assert 0 < types.count() < f["types"].select("name").distinct().count()
    every = chain(f).join(types.withColumnRenamed("name", "owner"), "owner", "left_semi").select(*asked.columns)
    assert rows(asked) == rows(every)
    # With the chains of all types at hand the findings are the same.
    forget_derived()
    chain(f)
    assert rows(findings(f)) == found and not f.has_derived("chain_asked")
    forget_derived()


def test_what_rules_found_meets_the_broken_files_once(spark):
    def one(uri, code):
        return spark.createDataFrame([(uri, 1, 1, code, "m", "warning", "high")], FINDING)

    syntax = one("bad", "syntax-error")
    out = I.combine(syntax, [one("bad", "unknown-method"), one("a", "unknown-method"), one("a", "unresolved-constant"), one("b", "argument-count")], "safe")
    assert [(r[0], r[3]) for r in rows(out)] == [("a", "unknown-method"), ("b", "argument-count"), ("bad", "syntax-error")]
    assert str(out._jdf.queryExecution().optimizedPlan()).count("LeftAnti") == 1
    assert rows(I.combine(syntax, [])) == rows(syntax)


def test_calls_carry_what_the_rules_need_of_the_lookup(spark):
    found = spark.createDataFrame(
        [("K", "one", 2, "instance_method", "::K", "one", "self", 1, 1, 0, False, False),
         ("K", "two", 1, "instance_method", "::M", "two", "include", 1, 0, 0, False, False),
         ("K", "two", 0, "instance_method", "::K", "two", "self", 1, 3, 0, False, False)],
        "receiver string, name string, rank int, sym_kind string, sym_owner string, sym_name string, origin string, n_sites long,"
        " n_required long, n_optional long, has_rest boolean, has_keywords boolean")
    pairs = {r.name: r for r in I.nearest_and_single(found).collect()}
    assert (pairs["one"].rank, pairs["one"].n_required, pairs["one"].has_keywords) == (2, 1, False)
    assert (pairs["two"].rank, pairs["two"].sym_owner, pairs["two"].n_required) == (0, "::K", None)
