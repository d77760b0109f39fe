"""Saved filter trees compiled to one Spark column (two-valued logic), hard filters, buckets, sort orders."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OPS = (
    "Equal", "NotEqual", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "In", "NotIn", "Between", "IsTrue", "IsFalse", "Contains",
)


@dataclass
class Leaf:
    """A test of one field; a null field passes only NotEqual and NotIn."""

    name: str
    op: str
    value: Any = None
    value_to: Any = None


@dataclass
class Node:
    """All, Any or Not (exactly one child) of its children; an empty All is true, an empty Any false."""

    logic: str
    children: list = field(default_factory=list)


def _number(x: Any) -> float:
    if isinstance(x, bool):
        return float(x)
    try:
        return float(x)
    except (TypeError, ValueError):
        return 0.0


def _numeric(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _text(x: Any) -> str:
    return str(x).lower()


def compile_leaf(leaf: Leaf, fields: dict[str, Column], lists: frozenset[str] = frozenset()) -> Column:
    """One leaf over resolved fields; comparisons ignore case, list fields know equality and membership alone."""
    if leaf.op not in OPS:
        raise ValueError(f"unknown operation {leaf.op}")
    c = fields.get(leaf.name, F.lit(None).cast("string"))
    many = [_text(v) for v in (leaf.value if isinstance(leaf.value, (list, tuple, set)) else [leaf.value])]
    if leaf.name in lists:
        overlap = F.coalesce(F.arrays_overlap(F.transform(c, F.lower), F.array(*map(F.lit, many))), F.lit(False))
        return overlap if leaf.op in ("Equal", "In") else ~overlap if leaf.op in ("NotEqual", "NotIn") else F.lit(False)
    low = F.lower(c.cast("string"))
    x = _numeric(c)
    value = _number(leaf.value)
    # Booleans count as 1 and 0, text that is no number as 0.
    truth = F.coalesce(c.try_cast("double"), F.when(low == "true", 1.0).otherwise(0.0))
    test = {
        "Equal": lambda: low == many[0],
        "NotEqual": lambda: low != many[0],
        "GreaterThan": lambda: x > value,
        "GreaterThanOrEqual": lambda: x >= value,
        "LessThan": lambda: x < value,
        "LessThanOrEqual": lambda: x <= value,
        "In": lambda: low.isin(many),
        "NotIn": lambda: ~low.isin(many),
        "Between": lambda: x.between(value, _number(leaf.value_to)),
        "IsTrue": lambda: truth != 0,
        "IsFalse": lambda: truth == 0,
        "Contains": lambda: low.contains(many[0]),
    }[leaf.op]()
    return F.when(c.isNull(), F.lit(leaf.op in ("NotEqual", "NotIn"))).otherwise(F.coalesce(test, F.lit(False)))


def compile_filter(tree: Leaf | Node, fields: dict[str, Column], lists: frozenset[str] = frozenset()) -> Column:
    """The whole tree as one boolean column that is never null."""
    if isinstance(tree, Leaf):
        return compile_leaf(tree, fields, lists)
    parts = [compile_filter(c, fields, lists) for c in tree.children]
    if tree.logic == "All":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    if tree.logic == "Any":
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    if tree.logic == "Not" and len(parts) == 1:
        return ~parts[0]
    raise ValueError("Not takes exactly one child; logic is All, Any or Not")


def hard_filter(
    jobs: DataFrame, as_of: str, require_salary: bool = False, min_salary: float | None = None, remote_only: bool = False, max_age_days: int | None = None,
    excluded_companies: tuple[str, ...] = (), locations: tuple[str, ...] = (),
) -> DataFrame:
    """Conjunction of the set conditions; a null salary counts as zero, a null location passes."""
    if require_salary:
        jobs = jobs.where(F.col("salary").isNotNull())
    if min_salary is not None:
        jobs = jobs.where(F.coalesce("salary", F.lit(0.0)) >= min_salary)
    if remote_only:
        jobs = jobs.where(F.coalesce("is_remote", F.lit(False)))
    if max_age_days is not None:
        jobs = jobs.where(F.datediff(F.to_date(F.lit(as_of)), "created") <= max_age_days)
    if excluded_companies:
        jobs = jobs.where(~F.coalesce(F.lower("company").isin([c.lower() for c in excluded_companies]), F.lit(False)))
    if locations:
        jobs = jobs.where(F.col("location").isNull() | reduce(lambda a, b: a | b, [F.lower("location").contains(x.lower()) for x in locations]))
    return jobs


def blocked(jobs: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Jobs whose company contains none of the blocked parts."""
    return jobs.where(~F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.coalesce(F.lower("company").contains(p), F.lit(False))))


def freshness(age_days: Column) -> Column:
    return F.when(age_days > 90, "Expired").when(age_days > 30, "Stale").when(age_days > 7, "Aging").otherwise("Fresh")


def salary_band(salary: Column) -> Column:
    return F.when(salary < 40000, "<40k").when(salary < 60000, "40-60k").when(salary < 80000, "60-80k").when(salary < 100000, "80-100k").otherwise("100k+")


def sort_by(df: DataFrame, criteria: list[tuple[str, bool]], tie: str) -> DataFrame:
    """Saved sort criteria (column, ascending), always closed by a unique column."""
    return df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in criteria], tie)


def stale_card(stage: Column, last_activity: Column, as_of: str, days: int = 14, terminal: tuple[int, ...] = (5, 6, 7, 8)) -> Column:
    """Not in a terminal stage and without activity for ``days`` or more."""
    return ~stage.isin(*terminal) & (F.datediff(F.to_date(F.lit(as_of)), F.to_date(last_activity)) >= days)


def tree_from_json(spec: dict) -> Leaf | Node:
    """A stored filter: {"logic": .., "children": [..]} or {"field": .., "op": .., "value": .., "value_to": ..}."""
    if "logic" in spec:
        return Node(spec["logic"], [tree_from_json(c) for c in spec.get("children", [])])
    return Leaf(spec["field"], spec["op"], spec.get("value"), spec.get("value_to"))


def saved_search(jobs: DataFrame, spec: dict, fields: dict[str, Column], tie: str, lists: frozenset[str] = frozenset()) -> DataFrame:
    """A stored search {"filter": tree, "sort": [[column, ascending]], "limit": n} over jobs; sorting is descending unless said otherwise."""
    out = jobs.where(compile_filter(tree_from_json(spec["filter"]), fields, lists)) if spec.get("filter") else jobs
    out = sort_by(out, [(c[0], bool(c[1]) if len(c) > 1 else False) for c in spec.get("sort", [])], tie)
    return out.limit(spec["limit"]) if spec.get("limit") else out


def dashboard(entries: DataFrame, category: str | None = None, text: str | None = None, least_strength: float = 0.0, dismissed: tuple[str, ...] = ()) -> DataFrame:
    """Ledger entries of a category, whose skill contains a text, of a strength, that are not dismissed; case is ignored."""
    out = entries.where(F.col("strength") >= least_strength)
    if category:
        out = out.where(F.lower("category") == category.lower())
    if text:
        out = out.where(F.lower("skill").contains(text.lower()))
    return out.where(~F.lower("skill").isin([d.lower() for d in dismissed])) if dismissed else out


def aspects(jobs: DataFrame, id_col: str, kinds: dict[str, Column]) -> DataFrame:
    """(kind, value, id) of every different aspect of the postings, without case: the form and the posting that had it first."""
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), v.alias("value")) for i, (k, v) in enumerate(kinds.items())])
    a = jobs.select(id_col, F.explode(rows).alias("a")).select(id_col, "a.*").withColumn("_low", F.lower("value"))
    first = a.groupBy("kind", "_low").agg(F.min_by(F.struct("value", id_col), F.struct(id_col, "i")).alias("b"))
    return first.select("kind", "b.value", f"b.{id_col}")


def company_cooldown(jobs: DataFrame, applied: DataFrame, days: int = 14) -> DataFrame:
    """Jobs at a company applied(company, applied) to within ``days`` before they were created; case is ignored."""
    last = applied.groupBy(F.lower("company").alias("_k")).agg(F.max("applied").alias("last"))
    hit = jobs.join(last, F.lower("company") == F.col("_k")).drop("_k")
    return hit.where(F.datediff("created", "last").between(0, days))


#: Kinds of company by marks in a posting's text, the first match wins; industries by theirs.
COMPANY_TYPES = [("Startup", ("startup", "seed", "series a")), ("Scale-up", ("scale-up", "scaleup", "series b")), ("Agency", ("agency", "consultancy")), ("Enterprise", ("enterprise", "fortune 500", "multinational"))]
INDUSTRIES = [("Fintech", ("fintech", "bank", "payments")), ("SaaS", ("saas",)), ("Healthcare", ("health", "medical")), ("Gaming", ("game", "gaming"))]


def job_fields(text: str = "text") -> dict[str, Column]:
    """Fields of a stored filter over postings (skills, preferred, salary_min, salary_max, company, location, title, is_remote, is_hybrid and a text)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {
        "skills": F.concat(F.coalesce("skills", F.array().cast("array<string>")), F.coalesce("preferred", F.array().cast("array<string>"))),
        "work_model": F.when(yes("is_remote"), "Remote").when(yes("is_hybrid"), "Hybrid").otherwise("Onsite"),
        "salary_min": F.col("salary_min"), "salary_max": F.col("salary_max"), "company": F.col("company"), "location": F.col("location"), "title": F.col("title"),
        "company_type": T.first_match(low, COMPANY_TYPES, "Unknown"), "industry": T.all_matches(low, INDUSTRIES), "is_remote": yes("is_remote"), "is_hybrid": yes("is_hybrid"),
    }


JOB_LISTS = frozenset({"skills", "industry"})
