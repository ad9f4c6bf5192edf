"""Budgets of a bundle: several running totals at once, the first document that goes beyond any of them, and all after it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicker.functions.text import utf16_key
from wicker.operators.running import running
from wicker.operators.structure import emptied


@dataclass(frozen=True)
class Budget:
    """What a row costs (signed: a refund is negative, null is nothing) and the most that a bundle may have spent."""

    name: str
    cost: Column
    most: int


def parser_budgets(front_units: int = 8 << 20, front_signs: int = 256_000, body_units: int = 8 << 20, body_lines: int = 100_000, body_signs: int = 80_000, links: int = 20_000, tags: int = 20_000) -> list[Budget]:
    """A bundle's budgets over parsed rows, in the order in which they are looked at; the defaults are the fixed values for interactive use."""
    work = lambda name: F.col(f"work.{name}")
    most = {"front_units": front_units, "front_signs": front_signs, "body_units": body_units, "body_lines": body_lines, "body_signs": body_signs}
    return [Budget(name, work(name), limit) for name, limit in most.items()] + [Budget("links", F.size("marks"), links), Budget("tags", F.size("tags"), tags)]


def spent(rows: DataFrame, budgets: list[Budget], within: str = "bundle_id", order: str = "path") -> DataFrame:
    """rows with spent (a struct of totals up to and with the row), state and budget.

    state is kept, over (the first row, in order, at which some total exceeds its budget) or skipped (all after it);
    budget names the first budget that the over row breaks. Groups are summed by runs, so none is held by one task.
    """
    key = utf16_key(F.col(order))
    costs = {f"_t_{b.name}": F.coalesce(b.cost, F.lit(0)).cast("long") for b in budgets}
    totals = running(rows, [within], key, costs)
    broken = F.coalesce(*[F.when(F.col(f"_t_{b.name}") > b.most, b.name) for b in budgets])
    marked = totals.withColumn("_broken", broken)
    first = marked.where("_broken IS NOT NULL").groupBy(F.col(within).alias("_in")).agg(F.min(F.struct(key.alias("k"), F.col("_broken").alias("b"))).alias("_first"))
    joined = marked.join(first, F.col(within).eqNullSafe(F.col("_in")), "left")
    state = F.when(F.col("_first").isNull() | (key < F.col("_first.k")), "kept").when(key == F.col("_first.k"), "over").otherwise("skipped")
    return joined.select(*rows.columns, F.struct(*[F.col(f"_t_{b.name}").alias(b.name) for b in budgets]).alias("spent"), state.alias("state"), F.when(state == "over", F.col("_first.b")).alias("budget"))


def limited(parsed: DataFrame, budgets: list[Budget]) -> DataFrame:
    """parsed with scope: documents beyond their bundle's budgets fail as resource-limit (scope bundle for the one that breaks a budget, document for those skipped), and their structure is empty."""
    rows = spent(parsed.where("path IS NOT NULL"), budgets)
    late = (F.col("state") != "kept") & F.col("failure").isNull()
    message = F.when(F.col("state") == "over", F.concat(F.lit("the bundle exceeds its budget of "), "budget")).otherwise("skipped after the bundle exceeded a budget")
    changed = emptied(late) | {"failure": F.when(late, "resource-limit").otherwise(F.col("failure")), "fault_message": F.when(late, message).otherwise(F.col("fault_message"))}
    scope = F.when(late & (F.col("state") == "over"), "bundle").when(F.col("failure") == "resource-limit", "document").when(late, "document")
    kept = rows.withColumn("scope", scope).select(*[(changed[c] if c in changed else F.col(c)).alias(c) for c in parsed.columns], "scope")
    return kept.unionByName(parsed.where("path IS NULL").withColumn("scope", F.lit(None).cast("string")))
