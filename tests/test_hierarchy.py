"""Ancestor chains against a plain in-order walk."""

import random

from factloom.operators import hierarchy as H
from factloom.operators.resolve import type_index

FACTS = "uri string, ordinal int, owner string, relation string, target string, nesting array<string>"


class Walk:
    """Depth-first model over already qualified names."""

    def __init__(self, types, facts):
        self.kinds = dict(types)
        self.links = {}
        self.sup = {}
        for f in sorted(facts, key=lambda f: f[1]):
            if f[3] == "superclass":
                self.sup[f[2]] = f[4]
            else:
                self.links.setdefault((f[2], f[3]), []).append(f[4])

    def entry(self, target, relation, seen):
        return [(None, relation)] if target is None or target == "Dup" else self.walk(target, False, relation, seen)

    def walk(self, name, singleton, origin, seen):
        if (name, singleton) in seen:
            return []
        seen.add((name, singleton))
        out = []
        if singleton:
            out.append((name, origin))
            for t in reversed(self.links.get((name, "extend"), [])):
                out += self.entry(t, "extend", seen)
        else:
            for t in reversed(self.links.get((name, "prepend"), [])):
                out += self.entry(t, "prepend", seen)
            out.append((name, origin))
            for t in reversed(self.links.get((name, "include"), [])):
                out += self.entry(t, "include", seen)
        if name in self.sup:
            parent = self.sup[name]
            if parent is None:
                out.append((None, "superclass"))
            elif parent in H.ROOT_SUPERCLASSES:
                out += [] if singleton else [(n, "default") for n, _ in H.OBJECT_TAIL]
            else:
                out += self.walk(parent, singleton, "superclass", seen)
        elif self.kinds.get(name) == "class" and not singleton:
            out += [(n, "default") for n, _ in H.OBJECT_TAIL]
        return out

    def chain(self, name, singleton):
        out = self.walk(name, singleton, "self", set())
        if singleton and all(n is not None for n, _ in out):
            tail = H.CLASS_OBJECT_TAIL if self.kinds.get(name) == "class" else H.MODULE_OBJECT_TAIL
            out += [(n, o) for n, _, o in tail]
        seen, kept = set(), []
        for n, o in out:
            side = "instance" if not singleton or o in H.INSTANCE_SIDE_ORIGINS else "singleton"
            if n is None or (n, side) not in seen:
                seen.add((n, side))
                kept.append((n, o))
        return kept


def graph(seed, cyclic):
    rng = random.Random(seed)
    n = rng.randint(3, 8)
    names = [f"::g{seed}::T{i}" for i in range(n)]
    types = [(t, rng.choice(["class", "class", "module"])) for t in names]
    facts, ordinal = [], 0
    for i, t in enumerate(names):
        pool = names if cyclic else names[:i]
        if pool and rng.random() < 0.6:
            target = None if rng.random() < 0.1 else ("Object" if rng.random() < 0.1 else rng.choice(pool))
            facts.append(("u", ordinal, t, "superclass", target, []))
            ordinal += 1
        for _ in range(rng.randint(0, 3)):
            if not pool:
                continue
            target = "Dup" if rng.random() < 0.1 else rng.choice(pool)
            facts.append(("u", ordinal, t, rng.choice(["include", "prepend", "extend"]), target, []))
            ordinal += 1
    return types, facts


def test_random_graphs_match_the_walk(spark):
    types, facts = [("::a::Dup", "module"), ("::b::Dup", "module")], []
    for seed in range(60):
        t, f = graph(seed, cyclic=seed % 2 == 0)
        types += t
        facts += f
    tdf = spark.createDataFrame(types, "name string, kind string")
    fdf = spark.createDataFrame(facts, FACTS)
    h = H.build(fdf, tdf, type_index(tdf))
    closure = H.superclass_closure(h.superclass)
    model = Walk(types, facts)
    for singleton in (False, True):
        rows = H.linearize(h, singleton=singleton, closure=closure).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.owner, r.pos)):
            got.setdefault(r.owner, []).append((r.name, r.origin))
        bad = {t for t, _ in types if got.get(t) != model.chain(t, singleton)}
        assert not bad, [(t, got.get(t), model.chain(t, singleton)) for t in list(bad)[:3]] + [len(bad)]


def test_thousand_deep_chain(spark):
    types = spark.range(1001).selectExpr("concat('::Gen', id) name", "'class' kind")
    facts = spark.range(1, 1001).selectExpr(
        "'u' uri", "cast(id as int) ordinal", "concat('::Gen', id) owner", "'superclass' relation",
        "concat('::Gen', id - 1) target", "cast(array() as array<string>) nesting",
    )
    h = H.build(facts, types, type_index(types))
    roots = types.filter("name = '::Gen1000'")
    chain = H.linearize(h, roots=roots).orderBy("pos").collect()
    assert [r.name for r in chain] == [f"::Gen{i}" for i in range(1000, -1, -1)] + ["Object", "Kernel", "BasicObject"]


def test_concern_class_methods(spark):
    types = [("::A", "class"), ("::C", "module"), ("::C::ClassMethods", "module"), ("::D", "module"), ("::D::ClassMethods", "module")]
    facts = [
        ("u", 1, "::A", "include", "C", []),
        ("u", 2, "::C", "concern_class_methods", None, []),
        ("u", 3, "::C", "include", "D", []),
        ("u", 4, "::D", "extend", "ActiveSupport::Concern", []),
    ]
    tdf = spark.createDataFrame(types, "name string, kind string")
    h = H.build(spark.createDataFrame(facts, FACTS), tdf, type_index(tdf))
    chain = H.linearize(h, roots=tdf.filter("name = '::A'"), singleton=True).orderBy("pos").collect()
    assert [r.name for r in chain][:3] == ["::A", "::C::ClassMethods", "::D::ClassMethods"]
    assert chain[1].decl_side == "instance_method"


def test_chains_are_dealt_over_tasks_by_their_rows(spark, monkeypatch):
    from factloom import session

    monkeypatch.setattr(session, "_ROWS_A_TASK", 50)
    types = [(f"::T{i}", "class") for i in range(60)]
    facts = [("a.rb", i, f"::T{i}", "superclass", f"::T{i - 1}", [f"::T{i}"]) for i in range(1, 60)]
    types_df = spark.createDataFrame(types, "name string, kind string")
    h = H.build(spark.createDataFrame(facts, FACTS), types_df, type_index(types_df))
    for singleton in (False, True):
        chain = H.linearize(h, singleton=singleton)
        assert chain.rdd.getNumPartitions() > 20
        assert {r.owner: r.n for r in chain.groupBy("owner").count().withColumnRenamed("count", "n").collect()} == {
            f"::T{i}": i + 1 + (7 if singleton else 3) for i in range(60)
        }
