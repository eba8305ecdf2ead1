"""Metric views: dimensions and measures defined once, aggregated at query time.

A view holds expressions in Spark SQL text.  A query picks names; the plan
joins only the tables those names reach, groups at the asked grain and
evaluates each measure there, so ratios stay right at every roll-up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import sketches


class MetricViewError(ValueError):
    """A definition or a query that breaks a rule of metric views."""


@dataclass(frozen=True)
class Join:
    """A left join: ``on`` is SQL over ``source`` or parent aliases; joins nest."""

    name: str
    table: str
    on: str
    joins: tuple[Join, ...] = ()


@dataclass(frozen=True)
class Dimension:
    name: str
    expr: str
    comment: str = ""


@dataclass(frozen=True)
class Measure:
    """``parts`` names additive aggregates that ``combine`` puts together.

    A measure without parts is one additive aggregate (SUM or COUNT) when
    ``additive`` is set; only such measures can be answered from a slice.
    Parts that do not add up, such as sketches, name the aggregate that merges
    them in ``merge``, with {} for the stored part.
    """

    name: str
    expr: str
    comment: str = ""
    additive: bool = False
    parts: dict[str, str] = field(default_factory=dict)
    combine: str = ""
    merge: dict[str, str] = field(default_factory=dict)


def distinct_measure(name: str, expr: str, comment: str = "") -> Measure:
    """A distinct count that a slice keeps as a sketch."""
    part, merge = sketches.distinct_part(expr)
    return Measure(
        name, f"theta_sketch_estimate({part})", comment, parts={"distinct": part}, combine="theta_sketch_estimate(distinct)",
        merge={"distinct": merge},
    )


def percentile_measure(name: str, expr: str, p: float, comment: str = "") -> Measure:
    """A percentile that a slice keeps as a sketch."""
    part, merge = sketches.quantile_part(expr)
    return Measure(
        name, f"kll_sketch_get_quantile_double({part}, {p}D)", comment, parts={"values": part},
        combine=f"kll_sketch_get_quantile_double(values, {p}D)", merge={"values": merge},
    )


@dataclass(frozen=True)
class MetricView:
    source: str
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]
    joins: tuple[Join, ...] = ()
    filter: str | None = None
    comment: str = ""

    # ---- definition -------------------------------------------------------

    def names(self) -> list[str]:
        return [d.name for d in self.dimensions] + [m.name for m in self.measures]

    def with_measure(self, measure: Measure) -> MetricView:
        """The same view with one more measure; nothing else changes."""
        return replace(self, measures=(*self.measures, measure))

    def dimension(self, name: str) -> Dimension:
        return _find(self.dimensions, name, "dimension")

    def measure(self, name: str) -> Measure:
        return _find(self.measures, name, "measure")

    def validate(self, tables) -> None:
        """Analyze every expression: dimensions must not aggregate, measures must."""
        names = self.names()
        if len(set(names)) != len(names):
            raise MetricViewError("field names must be unique")
        rows = self.joined(tables, [d.expr for d in self.dimensions] + [m.expr for m in self.measures])
        for d in self.dimensions:
            try:
                rows.groupBy(F.expr(d.expr).alias("d")).agg(F.count("*")).schema
            except AnalysisException as error:
                raise MetricViewError(f"dimension {d.name!r} is no row expression: {error.getCondition()}") from error
        for m in self.measures:
            try:
                # grouped by a constant: a column outside an aggregate is then refused
                rows.groupBy(F.lit(1).alias("_one")).agg(F.expr(m.expr).alias("m")).schema
            except AnalysisException as error:
                raise MetricViewError(f"measure {m.name!r} does not aggregate: {error.getCondition()}") from error

    # ---- planning ---------------------------------------------------------

    def joined(self, tables, expressions: list[str]) -> DataFrame:
        """The source, the always-on filter, and the joins the expressions reach."""
        needed = [e for e in (*expressions, self.filter) if e]
        rows = tables[self.source].alias("source")

        def reached(join: Join) -> bool:
            pattern = re.compile(rf"\b{re.escape(join.name)}\.")
            return any(pattern.search(e) for e in needed) or any(reached(j) for j in join.joins)

        def attach(rows: DataFrame, join: Join) -> DataFrame:
            if not reached(join):
                return rows
            rows = rows.join(tables[join.table].alias(join.name), F.expr(join.on), "left")
            for child in join.joins:
                rows = attach(rows, child)
            return rows

        for join in self.joins:
            rows = attach(rows, join)
        return rows.where(self.filter) if self.filter else rows

    def query(
        self,
        tables,
        dims: list[str],
        measures: list[str],
        where: str | None = None,
        having: str | None = None,
        order: list[str] | None = None,
        limit: int | None = None,
        casts: dict[str, str] | None = None,
        slice_rows: DataFrame | None = None,
    ) -> DataFrame:
        """Measures by dimensions.

        ``where`` is SQL over dimension names (in backticks), ``having`` and
        ``order`` over result names.  ``casts`` gives display types.  With
        ``slice_rows`` (from ``materialize``) the answer comes from the slice.
        """
        if "*" in dims or "*" in measures:
            raise MetricViewError("select all is not possible: name the fields")
        wrong = [n for n in dims if any(m.name == n for m in self.measures)]
        if wrong:
            raise MetricViewError(f"measures must be aggregated, not selected as dimensions: {wrong}")
        picked = [self.dimension(d) for d in dims]
        asked = [self.measure(m) for m in measures]
        if not asked:
            raise MetricViewError("ask for at least one measure")
        if slice_rows is not None:
            rows, aggregates = self._from_slice(slice_rows, dims, asked, where)
        else:
            filtered = [d for d in self.dimensions if where and f"`{d.name}`" in where]
            expressions = [d.expr for d in (*picked, *filtered)] + [m.expr for m in asked]
            rows = self.joined(tables, expressions)
            if where:
                condition = where
                for d in filtered:
                    condition = condition.replace(f"`{d.name}`", f"({d.expr})")
                rows = rows.where(condition)
            aggregates = [F.expr(m.expr).alias(m.name) for m in asked]
        if slice_rows is not None:
            keys: list[Column] = [F.col(f"`{d}`") for d in dims]
        else:
            keys = [F.expr(d.expr).alias(d.name) for d in picked]
        out = rows.groupBy(*keys).agg(*aggregates)
        if slice_rows is not None:
            out = self._combine(out, dims, asked)
        if having:
            out = out.where(having)
        if order:
            out = out.orderBy(*[F.expr(_order_name(o)).desc() if o.lower().endswith(" desc") else F.expr(o) for o in order])
        if limit is not None:
            out = out.limit(limit)
        for name, kind in (casts or {}).items():
            out = out.withColumn(name, F.col(f"`{name}`").cast(kind))
        return out

    # ---- materialization --------------------------------------------------

    def materialize(self, tables, dims: list[str], measures: list[str]) -> DataFrame:
        """Additive partials at the grain of ``dims``; store it and pass it as ``slice_rows``."""
        picked = [self.dimension(d) for d in dims]
        parts = {}
        for name in measures:
            parts.update(self._parts(self.measure(name)))
        rows = self.joined(tables, [d.expr for d in picked] + list(parts.values()))
        return rows.groupBy(*[F.expr(d.expr).alias(d.name) for d in picked]).agg(
            *[F.expr(e).alias(n) for n, e in parts.items()]
        )

    def answer(self, tables, slices: list[DataFrame], dims: list[str], measures: list[str], **rest) -> DataFrame:
        """The same as ``query``, from the smallest stored slice that can answer, else from the source.

        A slice with fewer dimensions is smaller; one fits if it holds every
        dimension and measure asked for and can apply the ``where`` condition.
        """
        def grain(rows: DataFrame) -> int:
            return sum("::" not in column for column in rows.columns)

        for rows in sorted(slices, key=grain):
            try:
                return self.query(tables, dims, measures, slice_rows=rows, **rest)
            except MetricViewError:
                continue  # does not fit; an unanswerable question fails below
        return self.query(tables, dims, measures, **rest)

    def unaggregated(self, tables, dims: list[str], columns: list[str]) -> DataFrame:
        """The joined rows with the dimensions and source columns, for storage."""
        picked = [self.dimension(d) for d in dims]
        rows = self.joined(tables, [d.expr for d in picked] + columns)
        return rows.select(*[F.expr(d.expr).alias(d.name) for d in picked], *[F.expr(c) for c in columns])

    def _parts(self, m: Measure) -> dict[str, str]:
        if m.parts:
            return {f"{m.name}::{p}": e for p, e in m.parts.items()}
        if m.additive:
            return {f"{m.name}::value": m.expr}
        raise MetricViewError(f"measure {m.name!r} cannot be re-aggregated")

    def _from_slice(self, rows: DataFrame, dims: list[str], asked: list[Measure], where: str | None):
        missing = [d for d in dims if d not in rows.columns]
        parts = [p for m in asked for p in self._parts(m)]
        missing += [p for p in parts if p not in rows.columns]
        if missing:
            raise MetricViewError(f"the slice does not hold {missing}")
        if where:
            try:
                rows = rows.where(where)
                rows.schema
            except AnalysisException as error:
                raise MetricViewError(f"the slice cannot apply {where!r}") from error
        merges = {f"{m.name}::{p}": how for m in asked for p, how in m.merge.items()}
        return rows, [F.expr(merges.get(p, "SUM({})").format(f"`{p}`")).alias(p) for p in dict.fromkeys(parts)]

    def _combine(self, out: DataFrame, dims: list[str], asked: list[Measure]) -> DataFrame:
        columns = [F.col(f"`{d}`") for d in dims]
        for m in asked:
            if m.parts:
                expression = m.combine
                for p in m.parts:
                    expression = re.sub(rf"\b{re.escape(p)}\b", f"`{m.name}::{p}`", expression)
                columns.append(F.expr(expression).alias(m.name))
            else:
                columns.append(F.col(f"`{m.name}::value`").alias(m.name))
        return out.select(*columns)

    # ---- names ------------------------------------------------------------

    def synonyms(self, spark) -> DataFrame:
        """(term, field): every name and every ``also known as`` entry, lower-cased."""
        rows = []
        for f in (*self.dimensions, *self.measures):
            rows.append((f.name.lower(), f.name))
            known = re.search(r"also known as:\s*([^.]*)", f.comment, re.IGNORECASE)
            rows += [(t.strip().lower(), f.name) for t in known.group(1).split(",") if t.strip()] if known else []
        return spark.createDataFrame(rows, "term string, field string")


def _order_name(item: str) -> str:
    return item.rsplit(" ", 1)[0]


def _find(items, name: str, kind: str):
    for item in items:
        if item.name == name:
            return item
    raise MetricViewError(f"unknown {kind} {name!r}")


def resolve_terms(terms: DataFrame, synonyms: DataFrame, column: str = "term") -> DataFrame:
    """Business words to fields by exact match on the normalized term."""
    keyed = terms.withColumn("_t", F.lower(F.trim(column)))
    return keyed.join(synonyms.select(F.col("term").alias("_t"), "field"), "_t", "left").drop("_t")


def result_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash of a result, for comparing answers."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    number = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(number).cast("string").alias("digest"))


def run_benchmark(view: MetricView, tables, questions: dict[str, dict], expected: dict[str, DataFrame]) -> DataFrame:
    """Run each verified question and compare its result with the expected frame."""
    rows = None
    for name, arguments in questions.items():
        got = result_digest(view.query(tables, **arguments)).withColumnsRenamed({"rows": "got_rows", "digest": "got"})
        want = result_digest(expected[name]).withColumnsRenamed({"rows": "want_rows", "digest": "want"})
        line = got.select(
            F.lit(name).alias("question"), "got_rows", want.select("want_rows").scalar().alias("want_rows"),
            F.col("got").eqNullSafe(want.select("want").scalar()).alias("matches"),
        )
        rows = line if rows is None else rows.union(line)
    return rows
