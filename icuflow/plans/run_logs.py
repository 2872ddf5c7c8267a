"""Reports over the logs of simulation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.operators.ordered import quantile_curve
from icuflow.operators.tables import occupancy_share

CURVES = {"los": ("los", "all"), "fatal_los": ("los", "fatal"), "doctors": ("care_time", "doctors"), "nurses": ("care_time", "nurses")}  # measure: section, name
CARE_UNITS = ["CSRU", "MICU", "SICU", "TSICU", "Other"]


def demand_by_run(model: DataFrame) -> DataFrame:
    """Final share of demand serviced per run, with staff and capacity.

    The staff columns may be swapped in the logs; the smaller number is the doctors.
    """
    return model.groupBy("run_number").agg(
        F.min_by(F.least("n_doctors", "n_nurses"), "step").alias("doctors"),
        F.min_by(F.greatest("n_doctors", "n_nurses"), "step").alias("nurses"),
        F.max("max_agents").alias("capacity"), F.max_by("demand_serviced", "step").alias("demand"),
    )


def agent_stay(agents: DataFrame, fatal: bool = False) -> DataFrame:
    """Longest day seen per run and agent, over all rows or the fatal ones."""
    rows = agents.filter(F.col("out_flag") == 1) if fatal else agents
    return rows.groupBy("run_number", "agent_id").agg(F.max("days_in_hospital").alias("los"))


def unit_occupancy(model: DataFrame, agents: DataFrame) -> DataFrame:
    capacity = model.groupBy("run_number").agg(F.max("max_agents").alias("capacity"))
    return occupancy_share(agents, capacity, ["run_number", "step"], "careunit", CARE_UNITS)


def run_log_report(model: DataFrame, agents: DataFrame, hold=lambda df, name: df) -> DataFrame:
    """One long table of (section, run_number, name, x, value) with every curve of the report."""
    occupancy = unit_occupancy(model, agents).unpivot(["run_number", "step"], CARE_UNITS, "name", "value").filter(
        F.col("value").isNotNull()
    ).select(F.lit("occupancy").alias("section"), "run_number", "name", F.col("step").cast("double").alias("x"), "value")
    demand = demand_by_run(model).unpivot(
        ["run_number", "demand"], ["doctors", "nurses", "capacity"], "name", "x"
    ).select(F.lit("demand").alias("section"), "run_number", "name", F.col("x").cast("double").alias("x"), F.col("demand").alias("value"))

    each = agent_totals(agents).unpivot(["run_number", "agent_id"], list(CURVES), "measure", "y").where("measure != 'fatal_los' or y is not null")
    curves = quantile_curve(each, "y", ["run_number", "measure"], hold=hold)
    names = {part: F.create_map(*[F.lit(x) for m, pair in CURVES.items() for x in (m, pair[i])])[F.col("measure")] for i, part in enumerate(("section", "name"))}
    return occupancy.unionByName(demand).unionByName(curves.select(
        names["section"].alias("section"), "run_number", names["name"].alias("name"), "x", F.col("y").alias("value")))


def agent_totals(agents: DataFrame) -> DataFrame:
    """Longest day, longest day of fatal rows and care time received, per run and agent in one aggregation."""
    return agents.groupBy("run_number", "agent_id").agg(
        F.max("days_in_hospital").cast("double").alias("los"),
        F.max(F.when(F.col("out_flag") == 1, F.col("days_in_hospital"))).cast("double").alias("fatal_los"),
        F.max("cum_caretime_doctors").cast("double").alias("doctors"), F.max("cum_caretime_nurses").cast("double").alias("nurses"),
    )
