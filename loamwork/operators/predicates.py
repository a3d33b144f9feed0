"""Filter predicates: a small tree, its JSON form, and its compilation to a Column.

A field test on a null field is null, so a Not around it drops the row as well
(three-valued logic, as in SQL).  Catalyst pushes what it can into the scan and
turns negations inward by itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_OPS = ("eq", "in", "gte", "lte", "contains_any", "contains_all")


@dataclass(frozen=True)
class Field:
    name: str
    op: str
    value: Any


@dataclass(frozen=True)
class And:
    clauses: tuple


@dataclass(frozen=True)
class Or:
    clauses: tuple


@dataclass(frozen=True)
class Not:
    clause: Any


def parse(node: Any) -> Any:
    """A predicate from its JSON object; malformed nodes vanish, and so do groups left empty (PRD-03)."""
    if not isinstance(node, dict):
        return None
    if {"field", "op"} <= node.keys():
        name, op = (str(node[k] or "").strip() for k in ("field", "op"))
        return Field(name, op, node.get("value")) if name and op else None
    for key, kind in (("and", And), ("or", Or)):
        if isinstance(node.get(key), list):
            inner = tuple(p for p in map(parse, node[key]) if p is not None)
            return kind(inner) if inner else None
    inner = parse(node.get("not"))
    return Not(inner) if inner is not None else None


def walk(predicate: Any) -> list[Any]:
    """All nodes of a tree, the root first."""
    if predicate is None:
        return []
    inner = getattr(predicate, "clauses", None) or ((predicate.clause,) if isinstance(predicate, Not) else ())
    return [predicate, *(n for c in inner for n in walk(c))]


def required_operators(predicate: Any) -> tuple[set[str], set[str]]:
    """Field operators and logical operators that a tree uses (PRD-04)."""
    nodes = walk(predicate)
    return {n.op for n in nodes if isinstance(n, Field)}, {type(n).__name__.lower() for n in nodes if not isinstance(n, Field)}


def problems(predicate: Any, ops: Sequence[str] = FIELD_OPS, logic: Sequence[str] = ("and", "or", "not")) -> list[str]:
    """What a backend with these capabilities cannot run (PRD-05)."""
    out = []
    for n in walk(predicate):
        if isinstance(n, Field):
            if not n.name.strip():
                out.append("blank field")
            if n.op not in ops:
                out.append(f"unsupported operator {n.op}")
        else:
            kind = type(n).__name__.lower()
            if kind not in logic:
                out.append(f"unsupported operator {kind}")
            if not isinstance(n, Not) and not n.clauses:
                out.append(f"empty {kind}")
    return out


def negated(predicate: Any) -> Any:
    """A tree without Not above And, Or or Not: De Morgan's laws (PRD-07)."""
    if isinstance(predicate, Not):
        inner = predicate.clause
        if isinstance(inner, Not):
            return negated(inner.clause)
        if isinstance(inner, (And, Or)):
            return (Or if isinstance(inner, And) else And)(tuple(negated(Not(c)) for c in inner.clauses))
        return predicate
    if isinstance(predicate, (And, Or)):
        return type(predicate)(tuple(map(negated, predicate.clauses)))
    return predicate


def compile(predicate: Any) -> Column:  # noqa: A001
    """The Column of a tree; no predicate keeps all rows (PRD-01, 02, 06)."""
    if predicate is None:
        return F.lit(True)
    if isinstance(predicate, And):
        return reduce(lambda a, b: a & b, map(compile, predicate.clauses))
    if isinstance(predicate, Or):
        return reduce(lambda a, b: a | b, map(compile, predicate.clauses))
    if isinstance(predicate, Not):
        return ~compile(predicate.clause)
    c, v = F.col(predicate.name), predicate.value
    as_list = list(v) if isinstance(v, (list, tuple, set)) else [v]
    tests = {
        "eq": lambda: c == v,
        "in": lambda: c.isin(*as_list),
        "gte": lambda: c >= v,
        "lte": lambda: c <= v,
        "contains_any": lambda: F.arrays_overlap(c, F.array(*map(F.lit, as_list))),
        "contains_all": lambda: F.size(F.array_except(F.array(*map(F.lit, as_list)), c)) == 0,
    }
    if predicate.op not in tests:
        raise ValueError(f"unknown operator {predicate.op}")
    return tests[predicate.op]()


def spec_problems(mode: str, top_k: Any, text: str | None = None, vector: Sequence[float] | None = None) -> list[str]:
    """What is wrong with a search request (PRD-08)."""
    out = []
    if mode not in ("lexical", "vector", "hybrid"):
        out.append("mode must be lexical, vector or hybrid")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1:
        out.append("top_k must be a positive integer")
    if mode in ("lexical", "hybrid") and not (text or "").strip():
        out.append(f"{mode} mode needs a text")
    if mode in ("vector", "hybrid") and not vector:
        out.append(f"{mode} mode needs a vector")
    return out
