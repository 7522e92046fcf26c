"""Constraints, audits and warnings.

A check is written ``name(arg, ...)``.  Most compile to aggregate expressions, and all of those on one
table run as a single aggregation; checks that need groups, windows or another table are frames of
one row.  Both give the number of violations, so a report is one DataFrame (check, violations,
passed) whatever was asked.  Users add checks with the ``check`` decorator.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import types
from ..functions.statistics import entropy_frame
from ..shared import written
from .joins import interval_overlaps

STAGES = ("constraint", "audit", "warning")
#: Fixed value: what counts as an e-mail address.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


class CheckError(ValueError):
    """A check that cannot be read."""


@dataclass
class Context:
    """What checks may need besides their table."""

    table: Callable[[str], DataFrame] | None = None
    now: Column = field(default_factory=F.current_timestamp)
    changes: DataFrame | None = None
    variables: dict[str, object] = field(default_factory=dict)

    def other(self, name: str) -> DataFrame:
        if self.table is None:
            raise CheckError(f"no other tables here: {name}")
        return self.table(name)


@dataclass
class Aggregate:
    """violations: a column over aggregates of the table."""

    violations: Column


@dataclass
class Frame:
    """violations: a DataFrame of one row and one column."""

    violations: DataFrame


REGISTRY: dict[tuple[str, str], Callable] = {}


def check(name: str, *stages: str):
    """Register fn(df, ctx, *args) -> Aggregate | Frame for the stages."""

    def keep(fn):
        for stage in stages:
            REGISTRY[stage, name] = fn
        return fn

    return keep


def split_arguments(text: str) -> list[str]:
    """Arguments between commas outside quotes, parentheses and braces."""
    out, depth, quote, now = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "({[":
            depth += 1
        elif c in ")}]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(now.strip())
            now = ""
            continue
        now += c
    return [*out, now.strip()] if now.strip() or out else out


def parse_directive(text: str) -> tuple[str, list[str]]:
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", text, re.S)
    if not m:
        raise CheckError(f"not a check: {text}")
    return m[1], [_unquoted(a) for a in split_arguments(m[2] or "")]


def _unquoted(text: str) -> str:
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace(text[0] * 2, text[0])
    return text


def literal(text: str) -> Column:
    """A number where it is one, else text."""
    t = text.strip()
    if re.fullmatch(r"[+-]?\d+", t):
        return F.lit(int(t))
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?", t):
        return F.lit(float(t))
    return F.lit(t)


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def _holds(a: Column, op: str, b: Column, allowed: str) -> Column:
    """a op b; operators that a check does not know hold always (``allowed`` lists those it knows)."""
    if op not in _OPS:
        raise CheckError(f"unknown operator {op}")
    return _OPS[op](a, b) if op in allowed.split() else F.lit(True)


def _col(df: DataFrame, name: str) -> Column:
    if name.lower() not in {c.lower() for c in df.columns}:
        raise CheckError(f"no column {name}")
    return F.col(f"`{name}`")


def _rows(condition: Column) -> Aggregate:
    """Rows where the condition is true."""
    return Aggregate(F.count_if(condition))


def _flag(condition: Column) -> Aggregate:
    """One violation if the condition on aggregates is true; null is none."""
    return Aggregate(F.coalesce(condition, F.lit(False)).cast("long"))


def _one(df: DataFrame, violations: Column) -> Frame:
    return Frame(df.agg(F.coalesce(violations.cast("long"), F.lit(0).cast("long")).alias("violations")))


def _text(c: Column) -> Column:
    return c.cast("string")


# --- values of one column -------------------------------------------------------------------


@check("not_null", "constraint", "warning")
def _not_null(df, ctx, col):
    return _rows(_col(df, col).isNull())


@check("not_empty", "constraint")
def _not_empty(df, ctx, col):
    c = _col(df, col)
    return _rows(c.isNull() | (F.trim(_text(c)) == ""))


@check("at_least_one", "constraint")
def _at_least_one(df, ctx, col):
    return _flag(F.count(_col(df, col)) == 0)


@check("null_percent", "constraint", "warning")
def _null_percent(df, ctx, col, most):
    share = F.try_divide(F.count_if(_col(df, col).isNull()) * F.lit(100.0), F.count(F.lit(1)))
    return _flag(share >= float(most))


@check("compare", "constraint", "warning")
def _compare(df, ctx, col, op, value):
    return _rows(~_holds(_col(df, col), op, literal(value), ">= > <= < = !="))


@check("between", "constraint")
def _between(df, ctx, col, low, high):
    c = _col(df, col)
    return _rows((c < literal(low)) | (c > literal(high)))


def _listed(values: tuple[str, ...]) -> list[str]:
    return [v.strip() for text in values for v in text.split(",")]


@check("in_list", "constraint")
def _in_list(df, ctx, col, *values):
    return _rows(~_text(_col(df, col)).isin(_listed(values)))


@check("not_in", "constraint")
def _not_in(df, ctx, col, *values):
    return _rows(_text(_col(df, col)).isin(_listed(values)))


@check("not_constant", "constraint")
def _not_constant(df, ctx, col):
    return _flag(F.countDistinct(_col(df, col)) < 2)


def _pattern(text: str) -> str:
    """LIKE without an escape character."""
    return text.replace("\\", "\\\\")


@check("like", "constraint")
def _like(df, ctx, col, pattern):
    return _rows(~_col(df, col).like(_pattern(pattern)))


@check("not_like", "constraint")
def _not_like(df, ctx, col, pattern):
    return _rows(_col(df, col).like(_pattern(pattern)))


def _full_match(c: Column, pattern: str) -> Column:
    return _text(c).rlike(rf"\A(?:{pattern})\z")


@check("matches", "constraint")
def _matches(df, ctx, col, pattern):
    return _rows(~_full_match(_col(df, col), pattern))


@check("email", "constraint")
def _email(df, ctx, col):
    return _rows(~_full_match(_col(df, col), EMAIL))


@check("uuid", "constraint")
def _uuid(df, ctx, col):
    return _rows(~_full_match(_col(df, col), types.TEXT_FORMS["UUID"]))


@check("valid_type", "constraint")
def _valid_type(df, ctx, col, kind):
    c = _col(df, col)
    name = types.normalize(kind)
    if name in types.TEXT_FORMS:
        return _rows(~_full_match(c, types.TEXT_FORMS[name]))
    return _rows(c.isNotNull() & _text(c).try_cast(types.parse(kind)).isNull())


@check("length_between", "constraint")
def _length_between(df, ctx, col, low, high):
    n = F.length(_text(_col(df, col)))
    return _rows((n < int(low)) | (n > int(high)))


@check("length_eq", "constraint")
def _length_eq(df, ctx, col, n):
    return _rows(F.length(_text(_col(df, col))) != int(n))


@check("no_nan", "constraint")
def _no_nan(df, ctx, col):
    return _rows(F.isnan(_col(df, col).cast("double")))


@check("finite", "constraint")
def _finite(df, ctx, col):
    c = _col(df, col).cast("double")
    return _rows(F.isnan(c) | (F.abs(c) == float("inf")))


@check("required_if", "constraint")
def _required_if(df, ctx, col, condition):
    return _rows(F.expr(condition) & _col(df, col).isNull())


@check("check", "constraint")
def _check(df, ctx, label, expression):
    return _rows(~F.expr(expression))


@check("distinct_count", "constraint")
def _distinct_count(df, ctx, col, op, n):
    return _flag(~_holds(F.countDistinct(_col(df, col)), op, F.lit(int(n)), ">= > <= < ="))


@check("duplicate_percent", "constraint")
def _duplicate_percent(df, ctx, col, most):
    rows = F.count(F.lit(1))
    return _flag(F.try_divide((rows - F.countDistinct(_col(df, col))) * F.lit(100.0), rows) >= float(most))


# --- groups, order and other tables ---------------------------------------------------------


@check("unique", "constraint", "warning")
def _unique(df, ctx, col):
    groups = df.groupBy(_col(df, col)).count().where("count > 1")
    return _one(groups, F.count(F.lit(1)))


@check("composite_unique", "constraint")
def _composite_unique(df, ctx, *cols):
    names = [c.strip().strip('"') for text in cols for c in text.split(",")]
    return _one(df.groupBy(*[_col(df, c) for c in names]).count().where("count > 1"), F.count(F.lit(1)))


@check("primary_key", "constraint")
def _primary_key(df, ctx, col):
    """Nulls, and rows beyond the first of each value; more than one null counts for both."""
    groups = df.groupBy(_col(df, col).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return _one(groups, F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0) + F.col("n") - 1))


@check("references", "constraint")
def _references(df, ctx, col, table, other):
    """NOT IN: a null among the referenced values makes every row pass."""
    keys = ctx.other(table).select(F.col(f"`{other}`").alias("k"))
    with_null = keys.where("k is null").select(F.lit(1).alias("some")).limit(1)
    alone = df.select(_col(df, col).alias("k")).where("k is not null").join(keys.distinct(), "k", "left_anti")
    return _one(alone.join(F.broadcast(with_null), F.lit(True), "left_anti"), F.count(F.lit(1)))


def gaps(df: DataFrame, col: str, step: float) -> DataFrame:
    """Rows of (value, before) where the next smaller value is more than ``step`` away.

    The order is total, but no task sorts it all: values are ranged over partitions, compared within
    each, and the first value of each partition is compared with the largest one before it.  The ranges
    are written, so all uses see the same ones.
    """
    values = df.select(_col(df, col).alias("v")).where("v is not null").distinct()
    ranged = written(values.repartitionByRange(F.col("v")).withColumn("p", F.spark_partition_id()), "gaps")
    ranged = ranged.withColumn("before", F.lag("v").over(Window.partitionBy("p").orderBy("v")))
    edges = ranged.groupBy("p").agg(F.min("v").alias("v"), F.max("v").alias("last"))
    edges = edges.withColumn("before", F.lag("last").over(Window.orderBy("v"))).select("v", "before")
    inner = ranged.where("before is not null").select("v", "before")
    return inner.unionByName(edges).where(F.col("v") - F.col("before") > step)


@check("sequential", "constraint")
def _sequential(df, ctx, col):
    return _one(gaps(df, col, 1), F.count(F.lit(1)))


@check("sequential_step", "constraint")
def _sequential_step(df, ctx, col, step):
    return _one(gaps(df, col, float(step)), F.count(F.lit(1)))


@check("no_overlap", "constraint")
def _no_overlap(df, ctx, start, end):
    """Intervals that begin before an earlier one has ended; equal starts do not count."""
    s = df.groupBy(_col(df, start).alias("s")).agg(F.max(_col(df, end)).alias("e")).where("s is not null")
    return _one(interval_overlaps(s, "s", "e"), F.count(F.lit(1)))


# --- audits ---------------------------------------------------------------------------------


@check("row_count", "audit", "warning")
def _row_count(df, ctx, op, n):
    if op == "!=":
        return Aggregate(F.lit(1).cast("long") + F.count(F.lit(1)) * 0)
    return _flag(~_holds(F.count(F.lit(1)), op, F.lit(int(n)), ">= > <= < ="))


def interval(text: str) -> Column:
    m = re.fullmatch(r"\s*(\d+)\s*(h|d|m|hours?|days?|minutes?|weeks?)\s*", text, re.I)
    if not m:
        raise CheckError(f"not an interval: {text}")
    unit = {"h": "HOUR", "d": "DAY", "m": "MINUTE"}.get(m[2].lower(), m[2].upper().rstrip("S"))
    return F.expr(f"INTERVAL '{m[1]}' {unit}" if unit != "WEEK" else f"INTERVAL '{7 * int(m[1])}' DAY")


@check("freshness", "audit", "warning")
def _freshness(df, ctx, col, age):
    last = F.max(_col(df, col)).cast("timestamp")
    return _flag(last.isNull() | (last < ctx.now - interval(age)))


def _statistic(value: Callable[[Column], Column], allowed: str, null_fails: bool = True):
    def run(df, ctx, col, op, bound):
        v = value(_col(df, col))
        wrong = ~_holds(v, op, literal(bound), allowed)
        return _flag(v.isNull() | wrong if null_fails else wrong)

    return run


def _sum(c: Column) -> Column:
    return F.sum(c)


REGISTRY["audit", "mean"] = _statistic(F.avg, ">= > <= < =")
REGISTRY["audit", "median"] = _statistic(F.median, ">= <= =")
REGISTRY["audit", "min"] = _statistic(F.min, ">= > <= < =")
REGISTRY["audit", "max"] = _statistic(F.max, ">= > <= < =")
REGISTRY["audit", "sum"] = _statistic(_sum, ">= > <= < =")
REGISTRY["audit", "approx_distinct"] = _statistic(F.approx_count_distinct, ">= <= =")
REGISTRY["warning", "min"] = _statistic(F.min, ">= > <= <")
REGISTRY["warning", "mean"] = _statistic(F.avg, ">= <", null_fails=False)
REGISTRY["warning", "cardinality"] = _statistic(F.approx_count_distinct, ">= <=", null_fails=False)


@check("mean_between", "audit")
def _mean_between(df, ctx, col, low, high):
    v = F.avg(_col(df, col))
    return _flag(v.isNull() | (v < float(low)) | (v > float(high)))


@check("stddev", "audit")
def _stddev(df, ctx, col, most):
    v = F.stddev_samp(_col(df, col))
    return _flag(v.isNull() | (v >= float(most)))


@check("percentile", "audit")
def _percentile(df, ctx, col, share, op, bound):
    return _flag(~_holds(F.percentile(_col(df, col), F.lit(float(share))), op, literal(bound), ">= > <= < ="))


@check("zscore", "audit")
def _zscore(df, ctx, col, threshold):
    c = _col(df, col).cast("double")
    about = df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
    far = df.select(c.alias("v")).join(F.broadcast(about), F.lit(True), "left")
    hit = F.try_divide(F.abs(F.col("v") - F.col("mean")), F.col("sd")) >= float(threshold)
    return _one(far, F.when(F.count("v") == 0, F.lit(1)).otherwise(F.count_if(hit)))


@check("entropy", "audit")
def _entropy(df, ctx, col, op, bound):
    e = F.col("entropy")
    wrong = ~_holds(e, op, F.lit(float(bound)), ">= <=")
    return _one(entropy_frame(df, col), F.max(wrong.cast("int")))


@check("low_entropy", "warning")
def _low_entropy(df, ctx, col, least):
    return _one(entropy_frame(df, col), F.max((F.col("entropy") < float(least)).cast("int")))


@check("reconcile_count", "audit")
def _reconcile_count(df, ctx, table):
    both = df.agg(F.count(F.lit(1)).alias("a")).join(ctx.other(table).agg(F.count(F.lit(1)).alias("b")), F.lit(True))
    return Frame(both.select((F.col("a") != F.col("b")).cast("long").alias("violations")))


@check("reconcile_sum", "audit")
def _reconcile_sum(df, ctx, col, table, other):
    both = df.agg(F.sum(_col(df, col)).alias("a")).join(ctx.other(table).agg(F.sum(f"`{other}`").alias("b")), F.lit(True))
    return Frame(both.select((~F.col("a").eqNullSafe(F.col("b"))).cast("long").alias("violations")))


@check("column_exists", "audit")
def _column_exists(df, ctx, col):
    return Aggregate(F.count(F.lit(1)) * 0 + int(col not in df.columns))


@check("column_type", "audit")
def _column_type(df, ctx, col, kind):
    found = {f.name: types.canonical(f.dataType) for f in df.schema.fields}
    return Aggregate(F.count(F.lit(1)) * 0 + int(col in found and found[col].upper() != kind.strip().upper()))


@check("golden", "audit")
def _golden(df, ctx, path):
    """Rows on one side only, of the table and a CSV file with a header."""
    expected = df.sparkSession.read.csv(path, header=True, schema=df.schema)
    return _one(df.subtract(expected).unionByName(expected.subtract(df)), F.count(F.lit(1)))


# --- warnings on changes --------------------------------------------------------------------


def _delta(df, ctx, most):
    """Changed rows (insertions, new values, deletions) per current row, in percent."""
    if ctx.changes is None:
        return Aggregate(F.count(F.lit(1)) * 0)
    changed = ctx.changes.agg(F.count_if(F.col("change_type").isin("insert", "update_postimage", "delete")).alias("a"))
    both = changed.join(df.agg(F.count(F.lit(1)).alias("b")), F.lit(True))
    return Frame(both.select(F.coalesce((F.try_divide(F.col("a") * F.lit(100.0), F.col("b")) > float(most)).cast("long"), F.lit(0).cast("long")).alias("violations")))


@check("row_count_delta", "warning")
def _row_count_delta(df, ctx, most):
    return _delta(df, ctx, most)


@check("sum_delta", "warning")
@check("mean_delta", "warning")
def _column_delta(df, ctx, col, most):
    """The same ratio as row_count_delta; the column only names what is watched."""
    return _delta(df, ctx, most)


@check("approaching_limit", "warning")
def _approaching_limit(df, ctx, col):
    limit = ctx.variables.get("alert_amount_threshold")
    return _flag(F.max(_col(df, col)) > F.lit(0.9) * F.lit(limit)) if limit is not None else Aggregate(F.count(F.lit(1)) * 0)


# --- running --------------------------------------------------------------------------------


def compile_check(stage: str, directive: str, df: DataFrame, ctx: Context) -> Aggregate | Frame:
    name, args = parse_directive(directive)
    fn = REGISTRY.get((stage, name))
    if fn is None:
        raise CheckError(f"unknown {stage}: {name}")
    try:
        return fn(df, ctx, *args)
    except TypeError as e:
        raise CheckError(f"{directive}: {e}") from e


def report(df: DataFrame, stage: str, directives: list[str], ctx: Context | None = None) -> DataFrame:
    """(check string, violations long, passed boolean), one row per directive; no job is run here."""
    ctx = ctx or Context()
    parts: list[DataFrame] = []
    singles: list[tuple[str, Column]] = []
    for d in directives:
        found = compile_check(stage, d, df, ctx)
        if isinstance(found, Aggregate):
            singles.append((d, found.violations))
        else:
            parts.append(found.violations.select(F.lit(d).alias("check"), F.col("violations").cast("long").alias("violations")))
    if singles:
        row = df.agg(*[v.cast("long").alias(f"v{i}") for i, (_, v) in enumerate(singles)])
        listed = F.array(*[F.struct(F.lit(d).alias("check"), F.col(f"v{i}").alias("violations")) for i, (d, _) in enumerate(singles)])
        parts.insert(0, row.select(F.inline(listed)))
    if not parts:
        return df.sparkSession.createDataFrame([], "check string, violations long, passed boolean")
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


def failures(df: DataFrame, stage: str, directives: list[str], ctx: Context | None = None) -> list[str]:
    """Messages of the checks that do not hold."""
    return [f"{r['check']}: {r['violations']} violation(s)" for r in report(df, stage, directives, ctx).collect() if not r["passed"]]
