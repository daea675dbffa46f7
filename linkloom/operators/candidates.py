"""Choosing what to look at next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed, values
from linkloom.operators.ordering import first_rows, numbered


def select_candidates(
    cands: DataFrame,
    dispatched: DataFrame,
    counts: DataFrame,
    budgets: DataFrame,
    permitted: list[str] | None = None,
    calls_per_action: int = fixed.CALLS_PER_ACTION_AND_ROUND,
) -> DataFrame:
    """Candidates to dispatch, best priority first: permitted action, new target, action under its limit, in budget.

    ``cands``: investigation_id, target, action, priority, position. ``dispatched``: investigation_id, target.
    ``counts``: investigation_id, action, calls of this round. ``budgets``: investigation_id, budget.
    """
    inv = "investigation_id"
    rows = cands if permitted is None else cands.where(F.col("action").isin(permitted))
    rows = rows.withColumn("_target", F.lower(values.trimmed(F.col("target"))))
    done = dispatched.select(inv, F.lower(values.trimmed(F.col("target"))).alias("_target")).distinct()
    fresh = first_rows(
        rows.join(done, [inv, "_target"], "left_anti"),
        [inv, "_target"],
        [F.col("priority"), F.col("position")],
    )
    used = counts.select(inv, "action", "calls")
    under = fresh.join(used, [inv, "action"], "left").where(
        F.coalesce("calls", F.lit(0)) < calls_per_action
    )
    ranked = numbered(under.drop("calls"), [inv], ["priority", "position"], "_rank")
    allowed = ranked.join(budgets.select(inv, "budget"), inv, "left").where(
        F.col("_rank") < F.coalesce("budget", F.lit(0))
    )
    return allowed.select(*cands.columns, F.col("_rank").alias("rank"))


def within_round_quota(calls: DataFrame, keys: list[str], order: list[str], quota: int) -> DataFrame:
    """The first ``quota`` calls of an action in a round."""
    return first_rows(calls, keys, [F.col(o) for o in order], quota)


def _actions(table: dict[str, list[str]], key: Column) -> Column:
    pairs = [x for kind, actions in table.items() for x in (F.lit(kind), F.array(*[F.lit(a) for a in actions]))]
    return F.try_element_at(F.create_map(*pairs), key)


def expand_actions(targets: DataFrame, type_col: str = "target_type") -> DataFrame:
    """One row per target and first action, in order."""
    wanted = F.coalesce(
        _actions(fixed.TARGET_ACTIONS, F.col(type_col)), _actions(fixed.TARGET_ACTIONS, F.lit("unknown"))
    )
    return targets.select("*", F.posexplode(wanted).alias("step", "action"))


def entity_actions(ents: DataFrame) -> DataFrame:
    """The action that can tell more about an entity, by its type."""
    table = F.create_map(*[F.lit(x) for pair in fixed.ENTITY_ACTIONS.items() for x in pair])
    return ents.withColumn("action", F.try_element_at(table, F.col("type"))).where(F.col("action").isNotNull())


def frontier(ents: DataFrame, obs: DataFrame, per_investigation: int) -> DataFrame:
    """Best entities that no observation has had as its target yet."""
    asked = obs.select("investigation_id", F.lower(values.trimmed(F.col("target"))).alias("_target")).distinct()
    rows = ents.withColumn("_target", F.lower("value")).join(asked, ["investigation_id", "_target"], "left_anti")
    return first_rows(
        rows.drop("_target"), ["investigation_id"], [F.desc("confidence"), F.col("id")], per_investigation
    )


def stop_conditions(inv: DataFrame, rounds: DataFrame) -> DataFrame:
    """Adds ``stop_reason``: budget used up, or as many rounds as the depth allows; null while work may go on."""
    depth = F.create_map(*[F.lit(x) for pair in fixed.DEPTH_ROUNDS.items() for x in pair])
    joined = inv.join(
        rounds.select(F.col("investigation_id").alias("id"), F.col("rounds").alias("_rounds")), "id", "left"
    )
    return joined.withColumn(
        "stop_reason",
        F.when(F.col("api_calls_used") >= F.col("api_budget"), "budget_exhausted").when(
            F.coalesce("_rounds", F.lit(0)) >= F.try_element_at(depth, F.col("depth")), "depth_reached"
        ),
    ).drop("_rounds")


def final_status(inv: DataFrame, reasons: DataFrame) -> DataFrame:
    """Adds ``final_status`` from the stop reason of an investigation; running ones keep their status."""
    joined = inv.join(reasons.select(F.col("investigation_id").alias("id"), "stop_reason"), "id", "left")
    return joined.withColumn(
        "final_status",
        F.when(F.col("stop_reason").isNull(), F.col("status"))
        .when(F.col("stop_reason").isin("external_stop", "budget_exhausted"), "stopped")
        .otherwise("completed"),
    )
