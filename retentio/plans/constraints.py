"""Declared keys, references and domains of the star, checked on stored tables.

A constraint is data; all of a kind are evaluated together, whatever the tables:

* *unique*: every rule of every table in one expand-and-aggregate shuffle.  A
  row gives one (rule, key) pair for each rule of its table, pairs are counted
  with a map-side combine, and a rule's violations are its copies beyond the
  first.  Keys with a NULL are left out, as SQL does.
* *reference*: one tagged union of parent keys and child keys, aggregated by
  (rule, key); the children of keys without a parent are the violations.  A key
  that a third of the children hold is one row per task.
* *not null*, *domain*, *range*, *trimmed*: one conditional count per rule, one
  pass per table.

The tables are a plain dictionary, so the same rules run on a warehouse read
from disk (``open_warehouse``), on a star, or on rows not yet accepted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R


@dataclass(frozen=True)
class Constraint:
    """``kind`` is unique, reference, not null, domain, range or trimmed; ``parent`` (table, columns) belongs to a
    reference, ``values`` to a domain, ``low`` and ``high`` (or None) to a range."""

    table: str
    kind: str
    columns: tuple[str, ...]
    parent: tuple[str, tuple[str, ...]] | None = None
    values: tuple[str, ...] = ()
    low: int | None = None
    high: int | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}: {', '.join(self.columns)}" + (f" -> {self.parent[0]}" if self.parent else "")


# --- fixed values: what the source model's tables declare, and the value sets of its staging checks
NOT_NULL_STAGING = ("customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure_months", "contract_type",
                    "paperless_billing", "payment_method", "monthly_charges", "churn")
YES_NO = ("Yes", "No")
DOMAINS = {"churn": YES_NO, "partner": YES_NO, "dependents": YES_NO, "senior_citizen": YES_NO, "paperless_billing": YES_NO,
           "gender": ("Male", "Female"), "contract_type": ("Month-to-month", "One year", "Two year")}
TRIMMED = ("customer_id", "contract_type", "payment_method", "internet_service")
DIMENSION_KEYS = {"dim_customer": "customer_key", "dim_contract": "contract_key", "dim_service_plan": "service_key", "dim_tenure": "date_key"}
# ---------------------------------------------------------------------------------


def declared() -> list[Constraint]:
    """The constraints of raw, staging and star."""
    out = [Constraint("raw", "domain", ("seniorcitizen",), values=("0", "1")), Constraint("raw", "trimmed", ("totalcharges",)),
           Constraint("staging", "unique", ("customer_id",)),
           Constraint("staging", "reference", ("customer_id",), parent=("dim_customer", ("customer_id",)))]
    out += [Constraint("staging", "not null", (c,)) for c in NOT_NULL_STAGING]
    out += [Constraint("staging", "domain", (c,), values=v) for c, v in DOMAINS.items()]
    out += [Constraint("staging", "trimmed", (c,)) for c in TRIMMED]
    out += [Constraint("staging", "range", ("tenure_months",), low=0, high=R.MAX_TENURE),
            Constraint("staging", "range", ("monthly_charges",), low=0)]
    naturals = {"dim_customer": ("customer_id",), "dim_contract": tuple(R.CONTRACT_COLUMNS),
                "dim_service_plan": tuple(R.SERVICE_COLUMNS), "dim_tenure": ("tenure_months",)}
    for table, key in DIMENSION_KEYS.items():
        out += [Constraint(table, "unique", (key,)), Constraint(table, "unique", naturals[table]), Constraint(table, "not null", (key,)),
                Constraint("fact_subscription", "reference", (key,), parent=(table, (key,))),
                Constraint("fact_subscription", "not null", (key,))]
    out += [Constraint("fact_subscription", "unique", ("subscription_key",)), Constraint("fact_subscription", "unique", ("customer_id",)),
            Constraint("fact_subscription", "reference", ("customer_id",), parent=("staging", ("customer_id",)))]
    return out


def _key(columns: Iterable[str]) -> Column:
    """A key of one or more columns as texts, or NULL if any of them is."""
    texts = [F.col(c).cast("string") for c in columns]
    whole = F.lit(True)
    for t in texts:
        whole = whole & t.isNotNull()
    return F.when(whole, F.array(*texts))


def _rows(rules: list[tuple[Constraint, DataFrame]]) -> DataFrame | None:
    """Names of the constraints with their counts."""
    out = None
    for part in rules:
        out = part if out is None else out.unionByName(part)
    return out


def _tagged(numbered: list[tuple[int, Constraint]], tables: dict[str, DataFrame], table: str, pick) -> DataFrame:
    """One row for each row of ``table`` and rule: rule, key and what ``pick`` adds, from one scan."""
    pairs = [F.struct(F.lit(i).alias("rule"), _key(columns).alias("key"), parent.alias("parent"))
             for i, columns, parent in pick(numbered, table)]
    return tables[table].select(F.explode(F.array(*pairs)).alias("p")).select("p.rule", "p.key", "p.parent").where("key IS NOT NULL")


def _unique(numbered, table):
    return [(i, c.columns, F.lit(False)) for i, c in numbered if c.table == table]


def _references(numbered, table):
    children = [(i, c.columns, F.lit(False)) for i, c in numbered if c.table == table]
    return children + [(i, c.parent[1], F.lit(True)) for i, c in numbered if c.parent and c.parent[0] == table]


def _counted(numbered, tables, pick, violations) -> DataFrame | None:
    pairs = None
    for table in tables:
        if pick(numbered, table):
            part = _tagged(numbered, tables, table, pick)
            pairs = part if pairs is None else pairs.unionByName(part)
    if pairs is None:
        return None
    per_key = pairs.groupBy("rule", "key").agg(F.count_if(~F.col("parent")).alias("rows"), F.max("parent").alias("has_parent"))
    return per_key.groupBy("rule").agg(F.sum(violations).cast("bigint").alias("violations"))


def _broken(c: Constraint) -> Column:
    v = F.col(c.columns[0])
    if c.kind == "not null":
        return v.isNull()
    if c.kind == "domain":
        return v.isNotNull() & ~v.isin(list(c.values))
    if c.kind == "trimmed":
        return v.isNotNull() & (v != F.trim(v))
    if c.kind == "range":
        out = F.lit(False)
        out = out | (v < c.low) if c.low is not None else out
        return v.isNotNull() & (out | (v > c.high) if c.high is not None else out)
    raise ValueError(f"unknown kind of constraint: {c.kind}")


def violations(constraints: list[Constraint], tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, constraint_name, kind and violations of every constraint, 0 included."""
    missing = {t for c in constraints for t in (c.table, *([c.parent[0]] if c.parent else []))} - set(tables)
    if missing:
        raise ValueError(f"no such tables: {sorted(missing)}")
    numbered = list(enumerate(constraints))
    unique = [(i, c) for i, c in numbered if c.kind == "unique"]
    references = [(i, c) for i, c in numbered if c.kind == "reference"]
    counts = [_counted(unique, tables, _unique, F.col("rows") - 1),
              _counted(references, tables, _references, F.when(F.col("has_parent"), 0).otherwise(F.col("rows")))]
    simple = [(i, c) for i, c in numbered if c.kind not in ("unique", "reference")]
    for table in dict.fromkeys(c.table for _, c in simple):
        mine = [(i, c) for i, c in simple if c.table == table]
        row = tables[table].agg(*[F.count_if(_broken(c)).alias(f"r{i}") for i, c in mine])
        counts.append(row.unpivot([], [f"r{i}" for i, _ in mine], "rule", "violations")
                      .select(F.substring("rule", 2, 9).cast("int").alias("rule"), "violations"))
    found = _rows([c for c in counts if c is not None])
    names = F.explode(F.array(*[F.struct(F.lit(i).alias("number"), F.lit(c.table).alias("table_name"), F.lit(c.name).alias("constraint_name"),
                                         F.lit(c.kind).alias("kind")) for i, c in numbered])).alias("c")
    listed = tables[constraints[0].table].sparkSession.range(1).select(names).select("c.*")
    return (listed.join(found, listed["number"] == found["rule"], "left")
            .select("table_name", "constraint_name", "kind", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))
            .orderBy("table_name", "constraint_name"))


def candidate_tables(pipeline) -> dict[str, DataFrame]:
    """The star's tables, with staging as it would be if every raw row were taken: numbers that don't cast are NULL."""
    from .staging import clean_columns

    return {"raw": pipeline.raw, "staging": pipeline.raw.select(*clean_columns(strict=False)), **pipeline.star.tables()}
