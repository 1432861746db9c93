"""What changed between two catalogs: the changes of all collections of their merged tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.operators import changes as c

#: What contexts and services are that don't say it.
CONTEXT_KIND, SERVICE_KIND = "bounded-context", "service"


def sides(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that the changes are told of, one row for each key: of several (two sources told it, and neither the claim nor the fold made one of them), the least."""
    empty = lambda name: F.nullif(name, F.lit(""))
    one = lambda df, *key: df.groupBy(*key).agg(*[F.min(x).alias(x) for x in df.columns if x not in key])
    out = {"contexts": t["contexts"].select("id", F.coalesce(empty("kind"), F.lit(CONTEXT_KIND)).alias("kind"), "classification")}
    out["services"] = one(t["services"].select("id", "context", F.coalesce(empty("kind"), F.lit(SERVICE_KIND)).alias("kind")), "id")
    for name in ("owners", "technologies", "stores"):
        out[f"service_{name}"] = t["services"].select("id", F.explode(name).alias("value")).distinct()
    out["interfaces"] = t["interfaces"].select("service", F.col("id").alias("interface")).distinct()
    http, soap = F.col("http"), F.col("soap")
    unknown = lambda x: F.coalesce(x, F.lit("?"))
    faults = F.transform(F.coalesce(soap["faults"], F.array().cast("array<string>")), lambda x: F.concat(F.lit("fault:"), x))
    spoken = F.array_join(F.concat(F.array(F.concat(F.lit("SOAP "), unknown(soap["version"])), *[unknown(soap[x]) for x in ("action", "endpoint", "binding")]), faults), " ")
    methods = t["methods"].select(
        "service", "interface", "name", "request", "response", "streaming", F.when(http.isNotNull(), F.coalesce(http["method"], F.lit(""))).alias("http_method"), F.when(http.isNotNull(), F.coalesce(http["path"], F.lit(""))).alias("http_path"),
        F.when(soap.isNotNull(), spoken).alias("soap"), F.coalesce("deprecated", F.lit(False)).alias("deprecated"),
    )
    out["methods"] = one(methods, "service", "interface", "name")
    out["calls"] = one(t["calls"].select("service", "id", "status"), "service", "id")
    out["channels"] = t["channels"].select("service", "address").distinct()
    coding = F.coalesce(empty("encoding"), empty("contentType"), F.lit("")).alias("encoding")
    out["messages"] = one(t["channel_messages"].select("service", "address", "direction", "name", coding), "service", "address", "direction", "name")
    out["aggregates"] = t["aggregates"].select("service", "id").distinct()
    consumers = one(t["consumers"].select("event", "consumer", "status"), "event", "consumer")
    n = consumers.groupBy(F.col("event").alias("id")).agg(F.count("*").alias("consumers"))
    out["events"] = t["events"].select("aggregate", "id").distinct().join(n, "id", "left").fillna(0, ["consumers"])
    out["consumers"] = consumers
    out["operations"] = t["operations"].select(F.col("aggregate").alias("owner"), "id").distinct()
    out["states"] = t["states"].select(F.col("aggregate").alias("owner"), F.col("state").alias("id")).distinct()
    out["transitions"] = t["transitions"].select(F.col("aggregate").alias("owner"), F.concat("from", F.lit(" --"), "on", F.lit("--> "), "to").alias("id")).distinct()
    out["lifecycles"] = out["states"].select("owner").unionByName(out["transitions"].select("owner")).distinct()
    out["stores"] = t["stores"].select("id", "owner")
    out["tables"] = t["relations"].where("relation_kind = 'table'").select(F.col("store").alias("owner"), F.col("name").alias("id")).distinct()
    out["modules"] = t["modules"].select("id", "commit")
    out["repos"] = t["repos"].select(F.col("repo").alias("id"), "commit")
    out["flows"] = t["flows"].select("id", "slug")
    text = F.concat("from", F.lit(" → "), "to", F.lit(" "), F.coalesce("label", "ref", "kind"))
    steps = t["flow_nodes"].where("type = 'step'").groupBy(F.col("flow_id").alias("flow"), F.col("node_id").alias("id")).agg(F.max_by(F.struct(text.alias("text"), "status"), "ord").alias("_s"))
    out["steps"] = steps.select("flow", "id", "_s.text", "_s.status")
    out["adrs"] = t["adrs"].select("id", "title", "status", F.col("supersededBy").alias("superseded_by"), "body")
    out["rfcs"] = t["rfcs"].select("id", F.coalesce("displayId", "id").alias("display"), "title", "status", "lifecycle", "repository", "body")
    out["specs"] = t["specs"].select("id", "lifecycle")
    out["requirements"] = one(t["requirements"].select("spec", "id", "title", "text"), "spec", "id")
    out["scenarios"] = one(t["scenarios"].select("requirement", "name", F.to_json(F.struct("when", "then")).alias("steps")), "requirement", "name")
    out["tasks"] = one(t["tasks"].select("spec", "id", "title", F.coalesce("done", F.lit(False)).alias("done")), "spec", "id")
    out["terms"] = t["terms"].select("id", "definition")
    return out


def catalog_changes(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """All changes between two catalogs (merged tables, enriched or not; written ones, as each is read several times): kind, severity, where, summary; see ``diff_catalogs`` for their order.

    What an entity holds is told only where both catalogs have the entity. A service in another context has moved; its parts are compared as ever. A lifecycle that is new or gone
    is one change; its states and transitions are told where both have one. Rows that nothing names (null keys) equal nothing.
    """
    a, b = sides(before), sides(after)
    pair = lambda name: (a[name], b[name])
    named = lambda name, old, new: tuple(df.select(F.col(old).alias(new)) for df in pair(name))
    services = named("services", "id", "service")
    aggregates = a["aggregates"].join(b["aggregates"], ["service", "id"]).join(services[0].join(services[1], "service"), "service", "left_semi").select(F.col("id").alias("aggregate")).distinct()
    owners = (aggregates.withColumnRenamed("aggregate", "owner"),) * 2
    lifecycles = tuple(df.join(owners[0], "owner", "left_semi") for df in pair("lifecycles"))
    events = tuple(df.join(aggregates, "aggregate", "left_semi").select(F.col("id").alias("event")) for df in pair("events"))
    slugs = a["flows"].select(F.col("id").alias("flow"), "slug")
    steps = tuple(df.join(slugs, "flow", "left") for df in pair("steps"))
    found = [
        c.context_changes(*pair("contexts")),
        c.service_changes(*pair("services")),
        c.set_changes(*pair("service_owners"), pair("services"), "owner", '{value} now owns "{id}"', '{value} no longer owns "{id}"', "breaking"),
        c.set_changes(*pair("service_technologies"), pair("services"), "technology", '"{id}" now uses {value}', '"{id}" no longer uses {value}'),
        c.set_changes(*pair("service_stores"), pair("services"), "service.store", '"{id}" touches {value}', '"{id}" no longer touches {value}'),
        c.interface_changes(*pair("interfaces"), services),
        c.method_changes(*pair("methods"), pair("interfaces")),
        c.call_changes(*pair("calls"), services),
        c.channel_changes(*pair("channels"), services),
        c.encoding_changes(*pair("messages")),
        c.Sides(*pair("aggregates"), ["service", "id"], "id").of(*services, ["service"]).added("aggregate", 'aggregate "{id}" is new').removed("aggregate", 'aggregate "{id}" is gone', "breaking").changes(),
        c.event_changes(*pair("events"), (aggregates, aggregates)),
        c.consumer_changes(*pair("consumers"), events),
        c.entity_changes(*(df.select(F.col("owner").alias("id")) for df in lifecycles), "lifecycle", '"{id}" has a lifecycle', '"{id}" no longer declares a lifecycle'),
        c.part_changes(*pair("states"), "state", '"{owner}" can now be {id}', '"{owner}" can no longer be {id}', "breaking", lifecycles),
        c.part_changes(*pair("transitions"), "transition", '"{owner}": {id}', '"{owner}" no longer: {id}', "breaking", lifecycles),
        c.part_changes(*pair("operations"), "operation", "{id} is new", "{id} is gone", "breaking", owners),
        c.store_changes(*pair("stores")),
        c.part_changes(*pair("tables"), "table", "{owner}.{id} is new", "{owner}.{id} is gone", "breaking", named("stores", "id", "owner")),
        c.pin_changes(*pair("modules"), "module"),
        c.pin_changes(*pair("repos"), "repo"),
        c.entity_changes(*pair("flows"), "flow", 'flow "{id}" is new', 'flow "{id}" is gone'),
        c.step_changes(*steps, named("flows", "id", "flow")),
        c.decision_changes(*pair("adrs")),
        c.proposal_changes(*pair("rfcs")),
        c.entity_changes(*pair("specs"), "spec", 'specification "{id}" is new', 'specification "{id}" is gone'),
        c.Sides(*pair("specs"), ["id"], "id").moved("spec.lifecycle", "lifecycle", "{id} is {now_lifecycle}, was {was_lifecycle}").changes(),
        c.requirement_changes(*pair("requirements"), named("specs", "id", "spec")),
        c.scenario_changes(*pair("scenarios"), named("requirements", "id", "requirement")),
        c.task_changes(*pair("tasks"), named("specs", "id", "spec")),
        c.field_changes(*pair("terms"), "term", "definition", "{id} is defined", "{id} is no longer defined", "{id} means something else now"),
    ]
    return reduce(DataFrame.unionByName, found)


def diff_catalogs(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """``catalog_changes`` in the order that they are shown in: breaking ones first."""
    return c.ordered([catalog_changes(before, after)])
