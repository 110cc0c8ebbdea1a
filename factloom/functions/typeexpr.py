"""Inferred types as canonical strings, and the algebra over them.

A type is written ``Unknown``, ``nil``, ``User``, ``Array[User]`` or a union of
those joined by `` | `` in text order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
NIL = "nil"

# Generic heads that describe the engine's own wrappers and never
# stand for the head class itself.
INTERNAL_GENERICS = ("ClassOf", "Relation", "CollectionProxy")
# Heads that behave like a list of their argument.
LIST_LIKE = ("Array", "Relation", "CollectionProxy")
# Database column type to language type.
COLUMN_TYPES = {
    "integer": "Integer",
    "bigint": "Integer",
    "float": "Float",
    "decimal": "BigDecimal",
    "boolean": "Boolean",
    "string": "String",
    "text": "String",
    "datetime": "Time",
    "date": "Date",
    "json": "Hash",
    "jsonb": "Hash",
    "uuid": "String",
}
UNMAPPED_COLUMN_TYPE = "Untyped"

_GENERIC = r"^([^\[\]|]+)\[(.*)\]$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_outside(type_: Column | str, separator: str) -> Column:
    """Pieces of a type between separators that lie in no bracket, at any depth.

    Where a bracket never closes, the rest from its piece on is the last piece.
    """
    t = _c(type_)
    pieces = F.split(t, separator.replace("|", r"\|"))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"), F.lit(0).alias("depth"))

    def step(acc: Column, piece: Column) -> Column:
        opened, closed = (F.length(piece) - F.length(F.translate(piece, c, "")) for c in ("[(", "])"))
        depth = acc["depth"] + opened - closed
        text = F.concat(acc["open"], piece)
        return F.struct(
            F.when(depth == 0, F.concat(acc["out"], F.array(text))).otherwise(acc["out"]).alias("out"),
            F.when(depth == 0, F.lit("")).otherwise(F.concat(text, F.lit(separator))).alias("open"), depth.alias("depth"))

    def finish(acc: Column) -> Column:
        rest = F.substring(acc["open"], F.lit(1), F.length(acc["open"]) - len(separator))
        return F.when(acc["open"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(rest)))

    # Where brackets are closed, not nested and hold no separator, every piece is whole.
    whole = rf"^[^\[\]()]*+(?:[\[(][^\[\](){separator.strip()}]*+[\])][^\[\]()]*+)*+\z"
    flat = (F.instr(t, "[") == 0) & (F.instr(t, "(") == 0) | t.rlike(whole)
    return F.when(flat, pieces).otherwise(F.aggregate(pieces, empty, step, finish))


def union_members(type_: Column | str) -> Column:
    """Outermost members of a type (one element when it is no union)."""
    return split_outside(type_, " | ")


def type_arguments(type_: Column | str) -> Column:
    """Arguments of a generic type, null for any other."""
    return split_outside(generic_arg(type_), ", ")


def is_union(type_: Column | str) -> Column:
    return F.contains(_c(type_), F.lit(" | ")) & (F.size(union_members(type_)) > 1)


def generic_head(type_: Column | str) -> Column:
    t = _c(type_)
    return F.when(~is_union(t), F.nullif(F.regexp_extract(t, _GENERIC, 1), F.lit("")))


def generic_arg(type_: Column | str) -> Column:
    t = _c(type_)
    return F.when(~is_union(t), F.nullif(F.regexp_extract(t, _GENERIC, 2), F.lit("")))


def is_nominal(type_: Column | str) -> Column:
    t = _c(type_)
    return ~is_union(t) & generic_head(t).isNull() & ~t.isin(UNKNOWN, NIL) & ~t.startswith("(")


def base_nominal(type_: Column | str) -> Column:
    """The class a receiver of this type dispatches on, or null."""
    t = _c(type_)
    head = generic_head(t)
    # A name by itself needs no look at brackets.
    plain = (F.instr(t, "[") == 0) & (F.instr(t, "(") == 0) & (F.instr(t, " | ") == 0)
    return F.when(plain, F.when(~t.isin(UNKNOWN, NIL), t)).when(is_nominal(t), t).when(head.isNotNull() & ~head.isin(*INTERNAL_GENERICS), head)


def nominal_members(type_: Column | str) -> Column:
    """Classes a receiver may dispatch on; members without one are left out."""
    t = _c(type_)
    # A name by itself needs no list of pieces.
    plain = (F.instr(t, "[") == 0) & (F.instr(t, "(") == 0) & (F.instr(t, " | ") == 0)
    pieces = F.filter(F.transform(union_members(t), base_nominal), lambda m: m.isNotNull())
    return F.when(plain & ~t.isin(UNKNOWN, NIL), F.array(t)).otherwise(pieces)


def class_receiver(type_: Column | str) -> Column:
    """``ClassOf[X]`` to ``(X, true)``, anything else to ``(itself, false)``."""
    t = _c(type_)
    wrapped = t.startswith("ClassOf[") & (generic_head(t) == "ClassOf")
    return F.struct(
        F.when(wrapped, generic_arg(t)).otherwise(t).alias("type"),
        F.coalesce(wrapped, F.lit(False)).alias("singleton"),
    )


def union_types(types: Column | str) -> Column:
    """Union of an array of types: flattened, an ``X`` beside ``X[Unknown]``
    dropped, distinct, in text order; nothing gives ``Unknown``."""
    flat = F.array_distinct(F.flatten(F.transform(F.filter(_c(types), lambda t: t.isNotNull()), union_members)))
    kept = F.filter(flat, lambda t: ~F.array_contains(flat, F.concat(t, F.lit("[Unknown]"))))
    ordered = F.array_sort(kept)
    return F.when(F.size(ordered) == 0, F.lit(UNKNOWN)).otherwise(F.array_join(ordered, " | "))


def or_nil(type_: Column | str) -> Column:
    return union_types(F.array(_c(type_), F.lit(NIL)))


def remove_nil(type_: Column | str) -> Column:
    return union_types(F.array_remove(union_members(type_), NIL))


def union_agg(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Union of ``col`` per key. Distinct first, so a group is no larger than
    its number of different types however many rows it has."""
    distinct = df.select(*keys, F.col(col).alias("_t")).distinct()
    return distinct.groupBy(*keys).agg(union_types(F.collect_list("_t")).alias(out))


def substitute(template: Column | str, bindings: Column, parameters: Sequence[str] = ("T", "U")) -> Column:
    """Replace type parameters in a template; an unbound one is ``Unknown``."""
    expr = _c(template)
    for p in parameters:
        # Two passes through a marker keep a bound value from being rebound.
        expr = F.regexp_replace(expr, rf"(?<![\w:]){p}(?![\w:])", f"\u0001{p}\u0001")
    for p in parameters:
        expr = F.replace(expr, F.lit(f"\u0001{p}\u0001"), F.coalesce(bindings[p], F.lit(UNKNOWN)))
    return union_types(F.array(expr))


def fill_parameters(template: Column | str, parameters: Column, bindings: Column) -> Column:
    """Replace the words of a template that are ``parameters`` (array) by their
    ``bindings`` (map); an unbound one is ``Unknown``. A bound value is not filled again."""
    words = F.regexp_extract_all(_c(template), F.lit(r"([\w:]+|[^\w:]+)"), 1)

    def filled(word: Column) -> Column:
        return F.when(F.array_contains(parameters, word), F.coalesce(F.try_element_at(bindings, word), F.lit(UNKNOWN))).otherwise(word)

    return union_types(F.array(F.array_join(F.transform(words, filled), "")))


def column_type(db_type: Column | str) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in COLUMN_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, _c(db_type)), F.lit(UNMAPPED_COLUMN_TYPE))


def observed_type(value_kind: Column | str, class_name: Column | str) -> Column:
    """Type of a traced value: ``nil``, a class object, or an instance."""
    kind, name = _c(value_kind), _c(class_name)
    return (
        F.when(kind == "nil", NIL)
        .when(name.isNull(), UNKNOWN)
        .when(kind == "module", F.concat(F.lit("ClassOf["), name, F.lit("]")))
        .otherwise(name)
    )
