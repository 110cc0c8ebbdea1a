"""Type expressions: brackets that do not close, arguments, and type parameters bound by structure."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import typeexpr as X
from factloom.operators import calls as C


@pytest.mark.parametrize(("type_", "members"), [
    ("A", ["A"]), ("A | nil", ["A", "nil"]), ("Array[A | B] | nil", ["Array[A | B]", "nil"]),
    ("Array[String | nil", ["Array[String | nil"]), ("A | Array[B | Hash[C] | D", ["A", "Array[B | Hash[C] | D"]),
    ("(A | B) -> C | nil", ["(A | B) -> C", "nil"]), ("", [""]),
])
def test_union_members(spark, type_, members):
    assert spark.createDataFrame([(type_,)], "t string").select(X.union_members("t")).first()[0] == members


def test_an_unclosed_type_keeps_its_row(spark):
    found = spark.createDataFrame([("Array[String | nil",)], "t string").select(F.explode(X.union_members("t")).alias("m"), X.union_types(F.array("t")).alias("u"))
    assert [tuple(r) for r in found.collect()] == [("Array[String | nil", "Array[String | nil")]


CASES = [
    ("Array[T]", ["T"], "Array[User]", {"T": "User"}),
    ("Array[T]", ["T"], "Array[User | nil]", {"T": "User | nil"}),
    ("Array[T]", ["T"], "Array[A] | Array[B] | Set[C] | nil", {"T": "A | B"}),
    ("Hash[K, V]", ["K", "V"], "Hash[Symbol, Hash[A, B]]", {"K": "Symbol", "V": "Hash[A, B]"}),
    ("Hash[K, Array[V]]", ["K", "V"], "Hash[Symbol, Array[A | B]]", {"K": "Symbol", "V": "A | B"}),
    ("Hash[K, Array[V]]", ["K", "V"], "Hash[Symbol, A]", {"K": "Symbol"}),
    ("Pair[T, T]", ["T"], "Pair[A, B]", {"T": "A | B"}),
    ("Array[T]", ["T"], "Array", {}), ("Hash[K, V]", ["K", "V"], "Hash[A]", {}), ("Array[T]", [], "Array[A]", {}), ("Array[T]", ["T"], None, {}),
]


def test_parameters_bind_by_structure(spark):
    pairs = spark.createDataFrame([(p, ps, t) for p, ps, t, _ in CASES], "pattern string, parameters array<string>, type string")
    found = {(r["pattern"], tuple(r["parameters"]), r["type"]): r["bindings"] for r in C.bind_parameters(pairs).collect()}
    assert found == {(p, tuple(ps), t): b for p, ps, t, b in CASES}


def test_filled_templates(spark):
    rows = [("Hash[V, K] | nil", "Hash[B, A] | nil"), ("Array[TK]", "Array[TK]"), ("Array[U]", "Array[Unknown]"), ("(K) -> V", "(A) -> B"), ("K::V", "K::V")]
    parameters = F.array(*map(F.lit, ("K", "V", "U")))
    bindings = F.create_map(*map(F.lit, ("K", "A", "V", "B")))
    found = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(X.fill_parameters("t", parameters, bindings)).collect()
    assert [r[0] for r in found] == [x for _, x in rows]
