"""Decode fact payloads; what cannot be decoded goes to a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import names as N
from factloom.functions import typeexpr as X
from factloom.session import durable

# Symbol kinds a payload may declare, and the largest accepted one.
SYMBOL_KINDS = ("instance_method", "singleton_method", "class", "module", "constant")
MAX_PAYLOAD_BYTES = 16 * 1024 * 1024


def _string_at(json: Column, path: str) -> Column:
    """A JSON string value; null for a missing key and for any other JSON type."""
    v = F.try_variant_get(json, path, "string")
    return F.when(F.schema_of_variant(F.try_variant_get(json, path, "variant")) == "STRING", v)


def _array_at(json: Column, path: str) -> Column:
    """A JSON array; empty for a missing or null one, one missing element for anything else."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(json, path, "variant")), F.lit("VOID"))
    lone = F.array(F.lit(None).cast("string").cast("variant"))
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(json, path, "array<variant>")).when(kind == "VOID", F.slice(lone, 1, 0)).otherwise(lone)


def _opened(encoded: DataFrame) -> DataFrame:
    """(parent, slot, v) with a number of its own, kind, name and the types inside."""
    v = F.col("v")
    rows = encoded.select(
        "parent", "slot", "v", _string_at(v, "$.kind").alias("kind"), F.nullif(_string_at(v, "$.name"), F.lit("")).alias("name"))
    one = lambda path: F.array(F.try_variant_get(v, path, "variant"))
    inner = (
        F.when(F.col("kind") == "generic", one("$.type_arg")).when(F.col("kind") == "union", _array_at(v, "$.members"))
        .when(F.col("kind") == "proc", F.concat(_array_at(v, "$.parameters"), one("$.return_type"))))
    return rows.select(F.monotonically_increasing_id().alias("node"), "parent", "slot", "kind", "name", inner.alias("inner"))


def decode_types(encoded: DataFrame) -> DataFrame:
    """(id, type) from (id, v): encoded types of any depth as canonical text, null where one does not decode.

    A worklist: the types inside the current ones are laid out as rows, level by
    level, until none is left; then texts are put together from the innermost level
    upwards. A level holds only what is nested so deep, so the work is the number of
    types, not rows times depth.
    """
    levels = [durable(_opened(encoded.select(F.col("id").alias("parent"), F.lit(0).alias("slot"), "v")))]
    while True:
        inside = levels[-1].filter("inner IS NOT NULL").select(F.col("node").alias("parent"), F.posexplode("inner").alias("slot", "v"))
        level = durable(_opened(inside))
        if level.isEmpty():
            break
        levels.append(level)
    texts: DataFrame | None = None
    for level in reversed(levels):
        plain = (
            F.when(F.col("kind") == "unknown", X.UNKNOWN).when(F.col("kind") == "nil", X.NIL)
            .when(F.col("kind").isin("nominal", "type_parameter"), F.col("name")))
        size = F.coalesce(F.size("inner"), F.lit(0))
        found = level.select("parent", "slot", "node", "kind", "name", size.alias("size"), plain.alias("text"))
        if texts is not None:
            parts = texts.filter("text IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
                F.transform(F.array_sort(F.collect_list(F.struct("slot", "text"))), lambda p: p["text"]).alias("parts"))
            found = found.join(parts, "node", "left")
            whole = F.size("parts") == F.col("size")
            given = F.array_join(F.slice("parts", 1, F.col("size") - 1), ", ")
            text = (
                F.when((F.col("kind") == "generic") & whole, F.concat("name", F.lit("["), F.col("parts")[0], F.lit("]")))
                .when((F.col("kind") == "union") & whole & (F.col("size") >= 2), F.array_join("parts", " | "))
                .when((F.col("kind") == "proc") & whole, F.concat(F.lit("("), given, F.lit(") -> "), F.element_at("parts", -1)))
                .otherwise(F.col("text")))
            found = found.withColumn("text", text)
        texts = durable(found.select("parent", "slot", "text"))
    return texts.select(F.col("parent").alias("id"), F.col("text").alias("type"))


def _facts(parsed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts and rejects with a reason from (keys, id, v); a return type that does not decode is null."""
    v = F.col("v")
    shown = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    read = parsed.select(
        *keys, "id", _string_at(v, "$.symbol_id.kind").alias("kind"), _string_at(v, "$.symbol_id.owner").alias("owner"),
        _string_at(v, "$.symbol_id.name").alias("name"),
        F.when(v.isNull(), "no JSON").when(~shown("$.symbol_id").startswith("OBJECT"), "no symbol")
        .when(~F.coalesce(_string_at(v, "$.symbol_id.kind").isin(*SYMBOL_KINDS), F.lit(False)), "unknown kind")
        .when(~F.coalesce(F.length(_string_at(v, "$.symbol_id.name")) > 0, F.lit(False)), "no name")
        .when(~shown("$.symbol_id.owner").isin("STRING", "VOID"), "owner is no text").alias("reason"))
    typed = decode_types(parsed.select("id", F.try_variant_get(v, "$.return_type", "variant").alias("v")).filter("v IS NOT NULL"))
    facts = read.filter("reason IS NULL").join(typed.withColumnRenamed("type", "return_type"), "id", "left")
    return (
        facts.select(*keys, "kind", N.qualify_owner("owner").alias("owner"), "name", "return_type"),
        read.filter("reason IS NOT NULL").select(*keys, "reason"))


def json_facts(raw: DataFrame, key: str, col: str) -> tuple[DataFrame, DataFrame]:
    """Plugin facts, one a row: (key, kind, owner, name, return_type), and the rejects (key, payload, reason)."""
    large = F.coalesce(F.octet_length(col) > MAX_PAYLOAD_BYTES, F.lit(False))
    parsed = durable(raw.select(key, col, large.alias("large"), F.try_parse_json(F.when(~large, F.col(col))).alias("v")).withColumn(
        "id", F.monotonically_increasing_id()))
    facts, rejects = _facts(parsed, [key, col, "large"])
    reason = F.when(F.col("large"), "too large").otherwise(F.col("reason"))
    return facts.drop(col, "large"), rejects.select(key, col, reason.alias("reason"))


def plugin_results(raw: DataFrame, key: str, col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers of plugins: facts (key, ordinal, kind, owner, name, return_type), summaries
    (key, section_names, reload_hooks) and rejects (key, ordinal, reason).

    An answer is ``{"ok": true, "result": …}`` with an array of declarations or a
    summary; a declaration is rejected by itself (``ordinal``), an answer as a whole.
    """
    large = F.coalesce(F.octet_length(col) > MAX_PAYLOAD_BYTES, F.lit(False))
    parsed = raw.select(key, large.alias("large"), F.try_parse_json(F.when(~large, F.col(col))).alias("v"))
    v = F.col("v")
    answer = durable(parsed.select(
        key, "large", v.isNotNull().alias("json"), F.try_variant_get(v, "$.ok", "boolean").alias("ok"),
        _string_at(v, "$.result.shape").alias("shape"), F.try_variant_get(v, "$.result", "variant").alias("v")))
    good = answer.filter("ok AND shape = 'declarations'")
    each = durable(good.select(key, F.posexplode(_array_at(v, "$.declarations")).alias("ordinal", "v")).withColumn(
        "id", F.monotonically_increasing_id()))
    facts, rejects = _facts(each, [key, "ordinal"])
    names = F.transform(_array_at(v, "$.snapshot_section_names"), lambda n: n.cast("string"))
    hooks = F.coalesce(F.try_variant_get(v, "$.reload_hook_count", "bigint"), F.lit(0))
    summaries = answer.filter("ok AND shape = 'summary'").select(key, names.alias("section_names"), hooks.alias("reload_hooks"))
    reason = (
        F.when(F.col("large"), "too large").when(~F.col("json"), "no JSON").when(F.col("ok") == F.lit(False), "plugin failed")
        .when(F.col("ok").isNull(), "no answer").when(~F.coalesce(F.col("shape").isin("declarations", "summary"), F.lit(False)), "unknown shape"))
    whole = answer.select(key, F.lit(None).cast("int").alias("ordinal"), reason.alias("reason")).filter("reason IS NOT NULL")
    return facts, summaries, rejects.unionByName(whole)


_MODEL = (
    "tableName string, partial boolean, columns array<struct<name:string,type:string,null:boolean>>, "
    "associations array<struct<name:string,macro:string,className:string,optional:boolean>>, "
    "instanceMethods array<string>, singletonMethods array<string>"
)


def model_facts(raw: DataFrame) -> DataFrame:
    """Model payloads (name, payload) to models with language types."""
    m = F.from_json("payload", _MODEL)
    parsed = raw.select("name", m.alias("m"))
    columns = F.transform(
        "m.columns",
        lambda c: F.struct(
            c["name"].alias("name"), X.column_type(c["type"]).alias("ruby_type"),
            F.coalesce(c["null"], F.lit(True)).alias("nullable"),
        ),
    )
    associations = F.transform(
        "m.associations",
        lambda a: F.struct(
            a["name"].alias("name"), a["macro"].alias("macro"), a["className"].alias("class_name"),
            F.coalesce(a["optional"], F.lit(True)).alias("optional"),
        ),
    )
    empty = F.array().cast("array<string>")
    return parsed.select(
        "name", F.col("m.tableName").alias("table_name"), F.coalesce("m.partial", F.lit(False)).alias("partial"),
        columns.alias("columns"), associations.alias("associations"),
        F.coalesce("m.instanceMethods", empty).alias("instance_methods"),
        F.coalesce("m.singletonMethods", empty).alias("singleton_methods"),
    )


_ROUTE = (
    "name string, verb string, pathTemplate string, requiredParts array<string>, optionalParts array<string>, "
    "defaults map<string,string>, sourceLocation struct<path:string,line:bigint>, routeSet string"
)


def route_facts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route payloads (ordinal, payload); nameless ones are rejected."""
    parsed = raw.select("ordinal", "payload", F.from_json("payload", _ROUTE).alias("r"))
    named = F.coalesce(F.length("r.name") > 0, F.lit(False))
    empty = F.array().cast("array<string>")
    routes = parsed.filter(named).select(
        "ordinal", "r.name", "r.verb",
        F.coalesce("r.requiredParts", empty).alias("required_parts"),
        F.coalesce("r.optionalParts", empty).alias("optional_parts"),
        F.col("r.defaults")["controller"].alias("controller"), F.col("r.defaults")["action"].alias("action"),
        "r.sourceLocation.path", "r.sourceLocation.line",
    )
    return routes, parsed.filter(~named).select("ordinal", "payload")
