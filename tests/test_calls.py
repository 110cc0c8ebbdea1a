"""Calls on class objects, constants, self and unions; answers merged by authority."""

from factloom.functions import typeexpr as X
from factloom.operators import calls as C
from factloom.operators import lookup as L
from factloom.operators import references as R
from factloom.operators import resolve

CHAIN = "owner string, pos int, name string, origin string, decl_side string"
HEADS = "kind string, owner string, name string, visibility string, uri string, line long, col long, n_sites long"
REQUESTS = "receiver_type string, name string, singleton boolean"


def tables(spark):
    instance = [("::A", 0, "::A", "self", "instance_method"), ("::A", 1, "::P", "superclass", "instance_method"), ("::A", 2, None, "superclass", "instance_method"),
                ("::B", 0, "::B", "self", "instance_method")]
    klass = [("::A", 0, "::A", "self", "singleton_method"), ("::A", 1, "::X", "extend", "instance_method"), ("::B", 0, "::B", "self", "singleton_method")]
    heads = [(k, o, n, "public", "u", 1, 1, 1) for k, o, n in [
        ("instance_method", "::A", "go"), ("instance_method", "::P", "go"), ("instance_method", "::P", "up"), ("instance_method", "::B", "go"),
        ("singleton_method", "::A", "make"), ("instance_method", "::X", "ext"), ("instance_method", "::A", "old")]]
    aliases = [("::A", "renamed", "old", False, 1)]
    return (spark.createDataFrame(instance, CHAIN), spark.createDataFrame(klass, CHAIN), spark.createDataFrame(heads, HEADS),
            spark.createDataFrame(aliases, "owner string, new_name string, old_name string, singleton boolean, ordinal long"))


ASKED = [
    ("A", "go", False), ("::A", "up", False), ("::A", "make", False), ("::A", "make", True), ("ClassOf[A]", "make", False), ("ClassOf[A]", "ext", False),
    ("ClassOf[A]", "go", False), ("::A | ::B", "go", False), ("::A | ::B | nil", "up", False), ("ClassOf[A] | ::B", "go", False), ("Relation[A]", "go", False),
    ("::A", "renamed", False), ("::A | ::B", "renamed", False)]


def test_each_receiver_asks_its_side(spark):
    found = L.lookup_calls(spark.createDataFrame(ASKED, REQUESTS), *tables(spark))
    got = {(r.receiver_type, r.name, r.singleton, r.sym_owner, r.sym_name, r.rank, r.conditional) for r in found.collect()}
    assert got == {
        ("A", "go", False, "::A", "go", 0, False), ("A", "go", False, "::P", "go", 1, False), ("::A", "up", False, "::P", "up", 1, False),
        ("::A", "make", True, "::A", "make", 0, False), ("ClassOf[A]", "make", False, "::A", "make", 0, False), ("ClassOf[A]", "ext", False, "::X", "ext", 1, False),
        ("::A | ::B", "go", False, "::A", "go", 0, False), ("::A | ::B", "go", False, "::P", "go", 1, False), ("::A | ::B", "go", False, "::B", "go", 0, False),
        ("::A | ::B | nil", "up", False, "::P", "up", 1, True), ("ClassOf[A] | ::B", "go", False, "::B", "go", 0, False),
        ("::A", "renamed", False, "::A", "old", 0, False), ("::A | ::B", "renamed", False, "::A", "old", 0, True)}


def test_availability_has_three_states(spark):
    asked = spark.createDataFrame([*ASKED, ("::B", "none", False), ("::C", "none", False), ("::B", "none", True)], REQUESTS)
    found = L.lookup_calls(asked, *tables(spark))
    reasons = spark.createDataFrame([("::A", "ancestor_not_identified"), ("::B", None)], "receiver string, reason string")
    class_reasons = spark.createDataFrame([("::A", None), ("::B", "surface_open")], "receiver string, reason string")
    got = {(r.receiver_type, r.name, r.singleton): (r.state, r.reason) for r in L.call_availability(asked, found, reasons, class_reasons).collect()}
    assert got["A", "go", False] == ("present", None)
    assert got["::A", "make", False] == ("unknown", "ancestor_not_identified")
    assert got["ClassOf[A]", "go", False] == ("absent", None)
    assert got["Relation[A]", "go", False] == ("unknown", "receiver_not_nominal")
    assert got["::B", "none", False] == ("absent", None)
    assert got["::B", "none", True] == ("unknown", "surface_open")
    assert got["::C", "none", False] == ("unknown", "ancestor_not_identified")


def test_nearest_target_and_doubt(spark):
    found = L.lookup_calls(spark.createDataFrame(ASKED, REQUESTS), *tables(spark))
    got = {(r.receiver_type, r.name): (r.sym_owner, r.conditional) for r in L.call_targets(found).filter("NOT singleton").collect()}
    assert got["::A | ::B", "go"] == ("::A", False)
    assert got["::A | ::B | nil", "up"] == ("::P", True)


def test_answers_by_authority(spark):
    calls = spark.createDataFrame([
        (1, "new", "K", False), (2, "new", "K", False), (3, "new", "Struct", True), (4, "find", "K", False), (5, "find", "K", False), (6, "x", None, False),
        (7, "x", None, False), (8, "x", None, False), (9, "x", "K", False)], "call_id long, name string, constant string, factory boolean")
    answers = spark.createDataFrame([
        (2, "own_singleton", "Made"), (2, "class_finder", "no"), (3, "own_singleton", "no"), (4, "direct_signature", "Unknown"), (4, "class_finder", "K"), (4, "own_singleton", "no"),
        (5, "direct_signature", "Sig"), (5, "class_finder", "no"), (6, "member", "M"), (6, "generic", "G"), (7, "observed", "Unknown"), (7, "class_finder", "no"),
        (8, "union_members", "Unknown"), (8, "inherited_signature", "I"), (8, "observed", "O"), (9, "generic", "G"), (9, "observed", None)],
        "call_id long, source string, type string")
    got = {r.call_id: (r.return_type, r.source) for r in C.merge_answers(calls, answers).collect()}
    assert got == {
        1: ("K", "constructor"), 2: ("Made", "own_singleton"), 3: ("Unknown", "factory"), 4: ("K", "class_finder"), 5: ("Sig", "direct_signature"),
        6: ("G", "generic"), 7: ("Unknown", "unknown"), 8: ("I", "inherited_signature"), 9: ("G", "generic")}


def test_unions_are_answered_by_their_members(spark):
    calls = spark.createDataFrame(
        [("a", "m", None, False, "A | B | nil"), ("b", "m", None, False, "A"), ("c", "m", None, False, "B | C"), ("d", "m", "K", False, "K | L")],
        "call_id string, name string, constant string, factory boolean, receiver_type string")
    known = spark.createDataFrame([("A", "X | nil"), ("B", "Y")], "receiver_type string, type string")
    sources = lambda c: c.join(known, "receiver_type").selectExpr("call_id", "'member' AS source", "type")
    got = {r.call_id: (r.return_type, r.source) for r in C.answer_calls(calls, sources).collect()}
    assert got == {"a": ("X | Y | nil", "union_members"), "b": ("X | nil", "member"), "c": ("Y", "union_members"), "d": ("Unknown", "unknown")}


def test_route_helpers_keep_the_first_fact(spark):
    facts = spark.createDataFrame([
        (2, "user", "POST", ["id"], None, "users", "update", "r.rb", 4), (1, "user", "PUT", ["id", "x"], ["format"], "users", "update", "", 3),
        (3, "user", "GET", [], [], "users", "show", "r.rb", 5), (4, "", "GET", [], [], "c", "a", "r.rb", 1), (5, "home", "GET", None, None, "h", "i", "r.rb", 9)],
        "ordinal long, name string, verb string, required_parts array<string>, optional_parts array<string>, controller string, action string, path string, line long")
    got = {r.name: r for r in R.route_helpers(facts).collect()}
    assert set(got) == {"user", "home"}
    assert (got["user"].required_parts, got["user"].optional_parts, got["user"].place) == (["id", "x"], ["format"], None)
    assert [tuple(t) for t in got["user"].targets] == [("users", "show", "GET"), ("users", "update", "PUT"), ("users", "update", "POST")]
    assert (got["home"].required_parts, tuple(got["home"].place)) == ([], ("r.rb", 9))


def test_later_lines_hide_an_alias(spark):
    aliases = spark.createDataFrame([("u", "A", "x", False, 5), ("u", "A", "y", True, 5), ("u", "A", "z", False, 5)], "uri string, owner string, new_name string, singleton boolean, line long")
    overrides = spark.createDataFrame([
        ("u", "A", "instance_method", "x", 6, "private"), ("u", "A", "instance_method", "y", 9, "private"), ("u", "A", "singleton_method", "y", 7, "protected"),
        ("u", "A", "instance_method", "z", 4, "private")], "uri string, owner string, kind string, name string, line long, visibility string")
    got = {(r.new_name, r.visibility) for r in C.apply_alias_visibility(aliases, overrides).collect()}
    assert got == {("x", "private"), ("y", "protected"), ("z", None)}


def test_definitions_list_each_place_once_and_hide_later_sources(spark):
    found = spark.createDataFrame(
        [(f"::K{i}", "m", "instance_method", o, "m") for i in range(5) for o in ("::M1", "::M2")] + [("::K9", "m", "instance_method", "::Gone", "m")],
        "receiver string, name string, sym_kind string, sym_owner string, sym_name string")
    sites = spark.createDataFrame(
        [("instance_method", o, "m", "lib/m.rb", line) for o in ("::M1", "::M2") for line in (1, 2, 2)],
        "sym_kind string, sym_owner string, sym_name string, uri string, line int")
    places = "receiver string, name string, uri string, line int"
    signature = spark.createDataFrame([("::K1", "m", "sig", 7), ("::K9", "m", "sig", 8), ("::K9", "m", "sig", 8)], places)
    model = spark.createDataFrame([("::K2", "m", "model", 1), ("::K9", "m", "model", 2), ("::K9", "x", "model", 3)], places)
    got = sorted(tuple(r) for r in C.definitions(found, sites, signature, model).select("receiver", "name", "source", "uri", "line").collect())
    assert got == sorted(
        [(f"::K{i}", "m", "source", "lib/m.rb", line) for i in range(5) for line in (1, 2)]
        + [("::K9", "m", "signature", "sig", 8), ("::K9", "x", "model", "model", 3)])


def test_definitions_keep_no_table_of_receivers_times_places(spark, monkeypatch):
    # Every receiver finds a set of symbols of its own; all of them find the one with many places.
    found = [(f"::K{i}", "m", "instance_method", o, "m") for i in range(40) for o in ("::M", f"::K{i}")]
    sites = [("instance_method", "::M", "m", "lib/m.rb", line) for line in range(50)] + [("instance_method", f"::K{i}", "m", "app/k.rb", i) for i in range(40)]
    # One place of two symbols, and one without a line.
    sites += [("instance_method", "::K3", "m", "lib/m.rb", 7), ("instance_method", "::K4", "m", "app/k.rb", None), ("instance_method", "::M", "m", "app/k.rb", None)]
    written = []
    durable = C.durable

    def counted(df):
        out = durable(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(C, "durable", counted)
    monkeypatch.setattr(C, "_ROWS_A_TASK", 100, raising=False)
    none = spark.createDataFrame([], "receiver string, name string, uri string, line int")
    got = [tuple(r) for r in C.definitions(
        spark.createDataFrame(found, "receiver string, name string, sym_kind string, sym_owner string, sym_name string"),
        spark.createDataFrame(sites, "sym_kind string, sym_owner string, sym_name string, uri string, line int"), none, none,
    ).select("receiver", "name", "source", "uri", "line").collect()]
    want = {(r, n, "source", u, at) for r, n, *s in found for *t, u, at in sites if s == t}
    assert len(got) == len(want) and set(got) == want
    assert max(written) <= len(found) + len(sites)


def test_types_are_taken_apart_once_for_lookup_and_availability(spark, monkeypatch):
    asked = spark.createDataFrame(ASKED, REQUESTS)
    members = L.receiver_members(asked)
    assert {(r.receiver_type, r.n_members) for r in members.collect()} == {
        ("A", 1), ("::A", 1), ("ClassOf[A]", 1), ("::A | ::B", 2), ("::A | ::B | nil", 2), ("ClassOf[A] | ::B", 1)}
    monkeypatch.setattr(L, "receiver_members", None)
    found = L.lookup_calls(asked, *tables(spark), members)
    reasons = spark.createDataFrame([("::A", None), ("::B", None)], "receiver string, reason string")
    assert L.call_availability(asked, found, reasons, reasons, members).count() == len(set(ASKED))


def test_availability_needs_only_what_the_classes_find(spark, monkeypatch):
    asked = spark.createDataFrame([*ASKED, ("::B", "none", False), ("::C", "none", False), ("::B", "none", True), ("::B", None, False)], REQUESTS)
    instance, klass, heads, aliases = tables(spark)
    reasons = spark.createDataFrame([("::A", "ancestor_not_identified"), ("::B", None)], "receiver string, reason string")
    class_reasons = spark.createDataFrame([("::A", None), ("::B", "surface_open")], "receiver string, reason string")
    want = {tuple(r) for r in L.call_availability(asked, L.lookup_calls(asked, instance, klass, heads, aliases), reasons, class_reasons).collect()}
    # No table of every symbol that every call finds.
    monkeypatch.setattr(L, "lookup_calls", None)
    lists = L.receiver_lists(asked)
    hits = L.hits(L.receiver_members(lists), L.both_sides(instance, klass), heads, aliases)
    got = [tuple(r) for r in L.call_availability(lists, hits, reasons, class_reasons).collect()]
    assert len(got) == len(want) and set(got) == want
    # As in SQL, a call without a name finds nothing and has no reason.
    assert ("::B", None, False, "absent", None) in got


def test_only_constants_meet_the_types(spark):
    types = spark.createDataFrame([("::A::C", "class"), ("::C", "class"), ("::D", "class")], "name string, kind string")
    calls = [(1, "constant", "C", "::O", ["::A"], None), (2, "constant", "C", "::O", ["::B"], None), (3, "constant", "C", "::O", None, None),
             (4, "constant", "::D", "::O", ["::A"], None), (5, "constant", "X", "::O", ["::A"], None), (6, "none", "C", "::O", ["::A"], None),
             (7, "expression", "C", "::O", ["::A"], "T"), (8, None, "C", "::O", ["::A"], "T"), (9, "constant", None, "::O", ["::A"], "T")]
    calls = spark.createDataFrame(calls, "id int, receiver_form string, receiver string, owner string, nesting array<string>, inferred_type string")
    rows = resolve.constant_receivers(calls, resolve.type_index(types))
    assert {r.id: r.receiver_type for r in rows.collect()} == {1: "::A::C", 2: "::C", 3: "::C", 4: "::D", 5: "X", 6: "::O", 7: "T", 8: "T", 9: None}
    # The other calls pass beside the joins.
    assert rows._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_types_without_nested_brackets_are_split_at_once(spark):
    got = spark.createDataFrame(
        [("ClassOf[A] | ::B",), ("A[B | C] | D",), ("A[B[C]] | nil",), ("A] | [B",), ("A[B",), (" | ".join(["A[B]"] * 9000),)], "t string"
    ).select("t", X.union_members("t").alias("m")).collect()
    got = {r.t: r.m for r in got}
    assert got["ClassOf[A] | ::B"] == ["ClassOf[A]", "::B"] and got["A[B | C] | D"] == ["A[B | C]", "D"] and got["A[B[C]] | nil"] == ["A[B[C]]", "nil"]
    assert got["A[B"] == ["A[B"] and len(got[" | ".join(["A[B]"] * 9000)]) == 9000


def test_nearest_target_comes_from_the_classes(spark):
    # ::S finds what it declares at once; in the union it counts where the first member finds it.
    instance, klass, heads, aliases = tables(spark)
    chain = [("::L", 0, "::L", "self", "instance_method"), ("::L", 1, "::M", "include", "instance_method"), ("::L", 2, "::S", "superclass", "instance_method"),
             ("::S", 0, "::S", "self", "instance_method"), ("::R", 0, "::Q", "prepend", "instance_method"), ("::R", 1, "::R", "self", "instance_method")]
    declared = [("instance_method", o, "far", "public", "u", 1, 1, 1) for o in ("::S", "::R")]
    instance = instance.unionByName(spark.createDataFrame(chain, CHAIN))
    heads = heads.unionByName(spark.createDataFrame(declared, HEADS))
    asked = spark.createDataFrame([*ASKED, ("::L | ::S | ::R", "far", False), ("::S", "far", False), ("::L | ::B", "far", False)], REQUESTS)
    want = {tuple(r) for r in L.call_targets(L.lookup_calls(asked, instance, klass, heads, aliases)).collect()}
    lists = L.receiver_lists(asked)
    hits = L.hits(L.receiver_members(lists), L.both_sides(instance, klass), heads, aliases)
    got = [tuple(r) for r in L.nearest_targets(lists, hits).collect()]
    assert len(got) == len(want) and set(got) == want
    assert ("::L | ::S | ::R", "far", False, "instance_method", "::R", "far", False) in got
