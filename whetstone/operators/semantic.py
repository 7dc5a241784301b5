"""Metrics over several tables: a model of measures, dimensions and many-to-one relationships, planned as Spark aggregations.

Facts never meet row by row. Each fact is grouped by its own dimensions and by the keys that lead out of it, then
joined to the tables those keys name (each join has at most one match, so no row counts twice), grouped by the
dimensions asked for, and the facts' results are brought together by one more grouping. All measures of a table share its
one scan.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a measure's parts of groups are put together again.
_TOGETHER = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """An aggregate of a SQL expression over one table: sum, count, min, max, avg or count_distinct."""

    kind: str
    expr: str = "1"
    where: str | None = None


@dataclass(frozen=True)
class Table:
    """Dimensions and measures by name, the time column if it has one, and the rules that its rows must meet."""

    dimensions: Mapping[str, str] = field(default_factory=dict)
    measures: Mapping[str, Measure] = field(default_factory=dict)
    time: str | None = None
    rules: Sequence[str] = ()


@dataclass(frozen=True)
class Relationship:
    """Many rows of `many` name one row of `one` by equal keys."""

    many: str
    one: str
    many_key: str
    one_key: str


@dataclass(frozen=True)
class Model:
    tables: Mapping[str, Table]
    relationships: Sequence[Relationship]
    #: SQL over {table.measure} and {other metric}.
    metrics: Mapping[str, str] = field(default_factory=dict)


def _column(name: str) -> str:
    return name.replace(".", "__")


def _names(expression: str) -> list[str]:
    return [n for _, n, _, _ in string.Formatter().parse(expression) if n is not None]


def _metric_order(model: Model, wanted: Sequence[str]) -> list[str]:
    """The metrics that `wanted` need, each after those it names; a cycle raises graphlib.CycleError."""
    needs, todo = {}, list(wanted)
    while todo:
        m = todo.pop()
        if m in needs or m not in model.metrics:
            continue
        needs[m] = {n for n in _names(model.metrics[m]) if n in model.metrics}
        todo += needs[m]
    return list(TopologicalSorter(needs).static_order())


def join_route(model: Model, start: str, end: str) -> list[Relationship]:
    """The shortest way of many-to-one steps; of equally short ones that of the relationships listed first. ValueError if there is none."""
    front: list[tuple[str, list[Relationship]]] = [(start, [])]
    seen = {start}
    while front:
        nxt = []
        for at, way in front:
            if at == end:
                return way
            for r in model.relationships:
                if r.many == at and r.one not in seen:
                    seen.add(r.one)
                    nxt.append((r.one, [*way, r]))
        front = nxt
    raise ValueError(f"no many-to-one way from {start} to {end}")


def _partial(name: str, m: Measure) -> list[Column]:
    x = F.expr(f"CASE WHEN {m.where} THEN {m.expr} END" if m.where else m.expr)
    if m.kind == "avg":
        return [F.sum(x).alias(f"{name}__sum"), F.count(x).alias(f"{name}__count")]
    return [{"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[m.kind](x).alias(name)]


def _merged(name: str, m: Measure) -> list[Column]:
    if m.kind == "avg":
        return [(F.sum(f"{name}__sum") / F.nullif(F.sum(f"{name}__count"), F.lit(0))).alias(name)]
    return [_TOGETHER[m.kind](name).alias(name)]


def _of_fact(model: Model, frames: Mapping[str, DataFrame], fact: str, measures: Mapping[str, Measure], dimensions: Sequence[str], grain: str | None) -> DataFrame:
    """One fact's measures by the dimensions. `measures`: by output name."""
    table, own, steps, far = model.tables[fact], {}, [], []
    for d in dimensions:
        of, name = d.split(".", 1)
        if of == fact:
            own[_column(d)] = F.expr(table.dimensions[name])
        else:
            far.append((_column(d), of, model.tables[of].dimensions[name]))
            steps += [r for r in join_route(model, fact, of) if r not in steps]
    if grain:
        if not table.time:
            raise ValueError(f"{fact} has no time column")
        own["period"] = F.date_trunc(grain, F.expr(table.time))
    rows = reduce(lambda df, rule: df.where(F.expr(rule)), table.rules, frames[fact])
    leading = list(dict.fromkeys(r.many_key for r in steps if r.many == fact))
    by = [*(c.alias(d) for d, c in own.items()), *(F.col(k).alias(f"__key_{k}") for k in leading)]
    exact = {n: m for n, m in measures.items() if m.kind == "count_distinct"}
    plain = {n: m for n, m in measures.items() if m.kind != "count_distinct"}
    # distinct values cannot be added up: they stay in the grouping, as rows of their own, and are counted at the end
    if exact:
        values = [F.expr(f"CASE WHEN {m.where} THEN {m.expr} END" if m.where else m.expr).alias(f"{n}__value") for n, m in exact.items()]
        by = [*by, *values]
    small = rows.groupBy(*by).agg(*([p for n, m in plain.items() for p in _partial(n, m)] or [F.count("*").alias("__rows")]))
    at: dict[str, dict[str, str]] = {fact: {k: f"__key_{k}" for k in leading}}
    for r in steps:
        left = at[r.many][r.many_key]
        wanted = {*(x.many_key for x in steps if x.many == r.one)}
        held = {k: f"__{r.one}_{k}" for k in wanted}
        more = [F.expr(e).alias(d) for d, of, e in far if of == r.one]
        one = frames[r.one].select(F.col(r.one_key).alias(f"__one_{r.one}"), *(F.col(k).alias(v) for k, v in held.items()), *more)
        small = small.join(one, F.col(left) == F.col(f"__one_{r.one}"), "left").drop(f"__one_{r.one}")
        at[r.one] = held
    out = [*map(_column, dimensions), *(["period"] if grain else [])]
    counted = [F.count_distinct(f"{n}__value").alias(n) for n in exact]
    return small.groupBy(*out).agg(*[x for n, m in plain.items() for x in _merged(n, m)], *counted)


def metrics(model: Model, frames: Mapping[str, DataFrame], wanted: Sequence[str], dimensions: Sequence[str] = (), grain: str | None = None) -> DataFrame:
    """(dimensions, period, wanted): metrics and measures by 'table.dimension' and a time grain.

    wanted: names of metrics, or 'table.measure'. A row a combination that any of the facts has; a measure of a fact without such
    rows is null there. Null dimensions are a value like others, and rows whose key names no row have null dimensions.
    Columns are named as asked, with `__` for the point. ValueError if a dimension cannot be reached from a fact.
    """
    order = _metric_order(model, wanted)
    used = list(dict.fromkeys(n for m in [*order] for n in _names(model.metrics[m]) if n not in model.metrics)) + [w for w in wanted if w not in model.metrics]
    by_fact: dict[str, dict[str, Measure]] = {}
    for u in dict.fromkeys(used):
        of, name = u.split(".", 1)
        by_fact.setdefault(of, {})[_column(u)] = model.tables[of].measures[name]
    keys = [*map(_column, dimensions), *(["period"] if grain else [])]
    facts = [_of_fact(model, frames, f, m, dimensions, grain) for f, m in by_fact.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    measures = [n for m in by_fact.values() for n in m]
    # each combination has one row a fact at most, so a grouping sets them side by side, nulls with nulls
    wide = every.groupBy(*keys).agg(*[F.max(n).alias(n) for n in measures])
    for m in order:
        text = model.metrics[m]
        for n in sorted(_names(text), key=len, reverse=True):
            text = text.replace("{" + n + "}", f"`{_column(n)}`")
        wide = wide.withColumn(m, F.expr(text))
    return wide.select(*keys, *map(_column, wanted))
