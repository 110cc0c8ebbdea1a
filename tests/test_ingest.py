"""Payloads of plugins: types of any depth, whole answers, and what is rejected why."""

import json

from factloom.sources import ingest

NIL, USER = {"kind": "nil"}, {"kind": "nominal", "name": "User"}


def generic(name, arg):
    return {"kind": "generic", "name": name, "type_arg": arg}


def nested(depth):
    return generic("Array", nested(depth - 1)) if depth else USER


TYPES = [
    (USER, "User"), ({"kind": "unknown"}, "Unknown"), ({"kind": "type_parameter", "name": "T"}, "T"),
    (nested(7), "Array[" * 7 + "User" + "]" * 7), (nested(12), "Array[" * 12 + "User" + "]" * 12),
    ({"kind": "union", "members": [generic("Hash", {"kind": "union", "members": [USER, NIL]}), NIL]}, "Hash[User | nil] | nil"),
    ({"kind": "proc", "parameters": [USER, nested(2)], "return_type": {"kind": "proc", "return_type": NIL}}, "(User, Array[Array[User]]) -> () -> nil"),
    ({"kind": "proc", "parameters": None, "return_type": NIL}, "() -> nil"),
    ({"kind": "union", "members": [USER]}, None), ({"kind": "union", "members": [USER, {"kind": "odd"}]}, None), ({"kind": "union"}, None),
    (generic("Array", {"kind": "nominal", "name": ""}), None), (generic("", USER), None), ({"kind": "generic", "name": "Array"}, None),
    ({"kind": "proc", "parameters": "x", "return_type": NIL}, None), ({"kind": "proc", "parameters": [USER]}, None),
    ({"kind": "nominal", "name": 7}, None), ("User", None), (None, None),
]


def fact(type_=USER, **symbol):
    return {"symbol_id": {"kind": "instance_method", "owner": "A", "name": "m"} | symbol, "return_type": type_}


def test_types_of_any_depth(spark):
    raw = spark.createDataFrame([(i, json.dumps(fact(t))) for i, (t, _) in enumerate(TYPES)], "n long, payload string")
    facts, rejects = ingest.json_facts(raw, "n", "payload")
    assert dict(facts.select("n", "return_type").collect()) == {i: text for i, (_, text) in enumerate(TYPES)}
    assert rejects.count() == 0


def test_rejects_say_why(spark):
    payloads = ["{", None, "[]", json.dumps(fact(kind="ivar")), json.dumps(fact(name="")), json.dumps(fact(name=3)), json.dumps(fact(owner=3)), json.dumps(fact(owner=None))]
    raw = spark.createDataFrame(list(enumerate(payloads)), "n long, payload string")
    facts, rejects = ingest.json_facts(raw, "n", "payload")
    assert dict(rejects.select("n", "reason").collect()) == {
        0: "no JSON", 1: "no JSON", 2: "no symbol", 3: "unknown kind", 4: "no name", 5: "no name", 6: "owner is no text"}
    assert [(r.n, r.owner) for r in facts.collect()] == [(7, None)]


def test_answers_of_plugins(spark):
    answers = [
        {"ok": True, "result": {"shape": "declarations", "declarations": [fact(), fact(nested(3), name="n"), fact(kind="odd"), 7]}},
        {"ok": True, "result": {"shape": "declarations", "declarations": []}},
        {"ok": True, "result": {"shape": "summary", "snapshot_section_names": ["a", 2], "reload_hook_count": 3}},
        {"ok": False, "error": "boom"}, {"ok": True, "result": {"shape": "other"}}, {"result": 1}, 5,
    ]
    raw = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(answers)] + [(7, "{")], "n long, payload string")
    facts, summaries, rejects = ingest.plugin_results(raw, "n", "payload")
    assert sorted((r.n, r.ordinal, r.owner, r.name, r.return_type) for r in facts.collect()) == [
        (0, 0, "::A", "m", "User"), (0, 1, "::A", "n", "Array[Array[Array[User]]]")]
    assert [tuple(r) for r in summaries.collect()] == [(2, ["a", "2"], 3)]
    assert sorted(map(tuple, rejects.collect()), key=repr) == sorted([
        (0, 2, "unknown kind"), (0, 3, "no symbol"), (3, None, "plugin failed"), (4, None, "unknown shape"), (5, None, "no answer"),
        (6, None, "no answer"), (7, None, "no JSON")], key=repr)


def test_nothing_to_decode(spark):
    facts, rejects = ingest.json_facts(spark.createDataFrame([], "n long, payload string"), "n", "payload")
    assert facts.count() == rejects.count() == 0
