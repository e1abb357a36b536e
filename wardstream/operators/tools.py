"""Read-only look-ups over scenarios with telemetry, and over the intelligence and technique tables, by name.

A scenario is a row (scenario, context, telemetry): telemetry holds one array of structs for each kind. A tool filters
scenarios, unnests one kind and filters its items: a projection with pushed filters, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import tools
from .retrieval import intel_lookup, telemetry, techniques


def scenario_items(scenarios: DataFrame, kind: str, scenario: str | None = None, hostname: str | None = None, username: str | None = None) -> DataFrame:
    """The telemetry items of one kind, of one scenario or (if its name is unknown) of all, on a host and for a user."""
    rows = scenarios
    if scenario:
        named = rows.filter(F.col("scenario") == scenario)
        rows = named if named.limit(1).count() else rows
    for field, value in (("hostname", hostname), ("username", username)):
        if value:
            rows = rows.filter(F.col(f"context.{field}") == value)
    return rows.select("scenario", F.explode(f"telemetry.{kind}").alias("item")).select("scenario", "item.*")


@tools.register("process")
def process(scenarios: DataFrame, process_name: str | None = None, **where: str) -> DataFrame:
    return telemetry(scenario_items(scenarios, "process", **where), contains={"process_name": process_name} if process_name else None)


@tools.register("network")
def network(scenarios: DataFrame, destination_ip: str | None = None, destination_port: int | None = None, **where: str) -> DataFrame:
    items = scenario_items(scenarios, "network", **where)
    return telemetry(items, equals={"destination_port": destination_port} if destination_port is not None else None, within={"destination_ip": destination_ip} if destination_ip else None)


@tools.register("auth")
def auth(scenarios: DataFrame, username: str | None = None, **where: str) -> DataFrame:
    """The user is looked for twice: as the scenario's user, and within the item's."""
    items = scenario_items(scenarios, "auth", username=username, **where)
    return telemetry(items, contains={"username": username} if username else None)


@tools.register("file")
def file(scenarios: DataFrame, path: str | None = None, **where: str) -> DataFrame:
    return telemetry(scenario_items(scenarios, "file", **where), contains={"path": path} if path else None)


@tools.register("alerts")
def alerts(scenarios: DataFrame, correlation_id: str | None = None, **where: str) -> DataFrame:
    return telemetry(scenario_items(scenarios, "alerts", **where), within={"correlation_id": correlation_id} if correlation_id else None)


@tools.register("threat_intel")
def threat_intel(asked: DataFrame, indicator: str = "indicator", kind: str | None = None) -> DataFrame:
    """The rows with found, reputation (unknown if not found), evidence_id and description of a match."""
    out = intel_lookup(asked, indicator, kind)
    text = F.concat(F.lit("Threat intelligence match for "), F.col(indicator), F.lit(": "), F.upper("reputation"), F.lit(" ("), "malware_family", F.lit(" attributed to "), "threat_actor", F.lit(")"))
    return out.withColumns({"description": text, "evidence_id": F.when(F.col("found"), F.col("evidence_id")), "reputation": F.coalesce("reputation", F.lit("unknown"))})


@tools.register("mitre_lookup")
def mitre_lookup(asked: DataFrame, technique_id: str = "technique_id", query: str = "query", evidence: int = 3) -> DataFrame:
    """Each asked row (id) with the techniques its id fragment, or else its words, are found in: rank by table order, and an
    evidence_id for the first few. Rows that ask for neither get none."""
    t = techniques(asked.sparkSession)
    t = t.withColumn("_o", F.monotonically_increasing_id()).withColumnsRenamed({"technique_id": "_id", "technique_name": "_name", "tactic": "_tactic"})
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    words = F.lower(F.concat_ws(" ", "_id", "_name", "_tactic"))
    hit = F.when(some(technique_id), F.col("_id").contains(F.upper(F.trim(technique_id)))).when(some(query), words.contains(F.lower(F.trim(query))))
    distinct = asked.select(technique_id, query).distinct()  # what is asked repeats; the search without an equality runs once for each
    found = distinct.join(F.broadcast(t), hit).groupBy(technique_id, query).agg(F.array_sort(F.collect_list(F.struct("_o", "_id", "_name", "_tactic"))).alias("m"))
    both = asked.join(found.withColumnsRenamed({technique_id: "_a", query: "_b"}), F.col(technique_id).eqNullSafe(F.col("_a")) & F.col(query).eqNullSafe(F.col("_b")))
    rows = both.select(*asked.columns, F.posexplode("m").alias("rank", "x"))
    mark = F.concat(F.lit("MITRE-"), F.replace(F.col("x._id"), F.lit("."), F.lit("_")))
    return rows.select(*asked.columns, "rank", F.col("x._id").alias("found_id"), F.col("x._name").alias("found_name"), F.col("x._tactic").alias("found_tactic"), F.when(F.col("rank") < evidence, mark).alias("evidence_id"))


__all__ = ["alerts", "auth", "file", "mitre_lookup", "network", "process", "scenario_items", "threat_intel"]
