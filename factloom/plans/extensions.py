"""What a plugin may add: rules for generic receivers and own diagnostics.

Both are DataFrames in and DataFrames out; nothing runs per row in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from factloom.operators.rules import FINDING

_RULES: list[DataFrame] = []
_DIAGNOSTICS: dict[str, Callable[[object], DataFrame]] = {}


def register_rules(rules: DataFrame) -> None:
    """Rows like those of :func:`factloom.operators.calls.rule_table`."""
    _RULES.append(rules)


def rules_with_plugins(built_in: DataFrame) -> DataFrame:
    """Built-in rules and registered ones; a built-in (head, method) stays."""
    out = built_in
    for extra in _RULES:
        out = out.unionByName(extra.join(out, ["head", "method"], "left_anti").select(*out.columns))
    return out


def register_diagnostic(name: str, build: Callable[[object], DataFrame]) -> None:
    """``build(facts)`` returns findings (uri, line, col, code, message,
    severity, confidence)."""
    _DIAGNOSTICS[name] = build


def plugin_findings(facts) -> DataFrame | None:
    out: DataFrame | None = None
    for build in _DIAGNOSTICS.values():
        found = build(facts).select(*FINDING)
        out = found if out is None else out.unionByName(found)
    return out


def clear() -> None:
    _RULES.clear()
    _DIAGNOSTICS.clear()


@contextmanager
def plugin(rules: DataFrame | None = None, **diagnostics: Callable[[object], DataFrame]) -> Iterator[None]:
    """Registered inside, and only there: what one plugin adds to a session."""
    before = list(_RULES), dict(_DIAGNOSTICS)
    if rules is not None:
        register_rules(rules)
    for name, build in diagnostics.items():
        register_diagnostic(name, build)
    try:
        yield
    finally:
        clear()
        _RULES.extend(before[0])
        _DIAGNOSTICS.update(before[1])


def diagnostic_names() -> tuple[str, ...]:
    return tuple(sorted(_DIAGNOSTICS))
