"""Rules and call resolution judge types once; call sites are joined once."""

from factloom.operators import references as R
from factloom.operators import rules as I

CALL = "uri string, line long, col long, receiver_form string, receiver_type string, name string"


def plan(df):
    return str(df._jdf.queryExecution().optimizedPlan()).splitlines()


def test_types_are_taken_apart_before_calls_meet_models(spark):
    calls = spark.createDataFrame(
        [("a", 1, 1, "expression", "::K", "x"), ("a", 2, 1, "expression", "K | nil", "x"), ("a", 3, 1, "expression", None, "x")], CALL)
    methods = spark.createDataFrame([], "receiver_type string, name string, sym_kind string, sym_owner string, sym_name string, conditional boolean")
    members = spark.createDataFrame([("K", "x", "active_record_column")], "model string, member string, kind string")
    routes = spark.createDataFrame([], "name string")
    found = R.resolve_calls(calls, methods, members, routes)
    assert {(r.line, r.sym_kind, r.sym_owner) for r in found.collect()} == {(1, "active_record_column", "::K"), (2, None, None), (3, None, None)}
    assert not [line for line in plan(found) if "Join LeftOuter" in line and "split(" in line]


def test_types_of_arguments_are_judged_once_a_pair(spark, monkeypatch):
    args = spark.createDataFrame(
        [("a", i, 1, "K", "m", ["A"]) for i in range(5)] + [("a", 9, 1, "K", "m", ["B"]), ("a", 10, 1, "K", "m", ["Array[A]"]), ("a", 11, 1, "K", "m", [None])],
        "uri string, line long, col long, receiver_type string, name string, arg_types array<string>")
    overloads = spark.createDataFrame([("K", "m", ["T"], [], [])], "receiver string, name string, required array<string>, optional array<string>, trailing array<string>")
    reachable = spark.createDataFrame([("B", "T"), ("A", "U")], "actual string, target string")
    given = []
    judge = I.incompatible
    monkeypatch.setattr(I, "incompatible", lambda pairs, names: given.append(pairs.count()) or judge(pairs, names))
    found = I.argument_types(args, overloads, reachable)
    assert {(r.line, r.message) for r in found.collect()} == {(i, "`m` expects T here, but A is given") for i in range(5)}
    assert given == [2]


def test_call_sites_are_kept_for_the_queries_that_read_them(spark):
    from factloom.plans.facts import Facts
    from factloom.plans.q_diagnose import calls

    f = Facts(spark, "/root/testdata/sf0.001")
    assert calls(f).count() and not [line for line in plan(calls(f)) if "Join" in line]
