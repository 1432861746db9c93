"""Integrity of a merged catalog: every violation of every collection as a row (rule, subject, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.validate import duplicates, failing, violations

#: What enumerated fields may hold.
ALLOWED = {
    ("contexts", "kind"): ["bounded-context", "system", "product", "team", "namespace"],
    ("contexts", "classification"): ["core", "supporting", "generic"],
    ("services", "kind"): ["service", "application", "webapp", "worker", "job", "function", "cli", "library", "data-pipeline"],
    ("channels", "kind"): ["event", "job", "message"],
    ("channel_messages", "direction"): ["send", "receive"],
    ("methods", "streaming"): ["client", "server", "bidi"],
    ("stores", "kind"): ["postgres", "mysql", "sqlite", "redis", "mongodb", "clickhouse", "s3", "dynamodb", "other"],
    ("relations", "role"): ["aggregate-root", "child", "outbox", "projection", "lookup", "other"],
    ("accesses", "operation"): ["read", "write", "delete"],
    ("operations", "kind"): ["command", "query"],
    ("participants", "kind"): ["actor", "service", "broker", "store", "external", "unknown"],
    ("calls", "status"): ["verified", "declared", "unresolved"],
    ("consumers", "status"): ["verified", "declared", "unresolved"],
}
#: Lifecycles of a proposal.
LIFECYCLES = ("draft", "discussion", "accepted", "implemented", "rejected", "postponed", "withdrawn", "abandoned", "superseded", "unknown")
#: What names a row of each table.
NAMES = {
    "channels": ["service", "address"], "channel_messages": ["service", "address", "name"], "methods": ["interface", "name"], "accesses": ["relation", "operation"], "participants": ["flow", "id"],
    "calls": ["service", "id"], "consumers": ["event", "consumer"],
}


def _name(table: str) -> Column:
    return F.concat_ws("/", *NAMES.get(table, ["id"]))


def _lost(df: DataFrame, ref: str, targets: DataFrame, key: str, rule: str, subject: Column) -> DataFrame:
    """Rows whose reference leads nowhere, each by its own name."""
    gone = df.where(F.col(ref).isNotNull() & (F.col(ref) != "")).withColumn("_ref", F.col(ref)).join(targets.select(F.col(key).alias("_ref")).distinct(), "_ref", "left_anti")
    return gone.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), F.col(ref).cast("string").alias("detail"))


def catalog_violations(t: dict[str, DataFrame]) -> DataFrame:
    """All checks over merged tables. A clean catalog gives no rows."""
    c, out = F.col, []
    for (table, field), allowed in ALLOWED.items():
        bad = t[table].where(c(field).isNotNull() & (c(field) != ""))
        out.append(failing(bad, c(field).isin(allowed), f"{table}-{field}-unknown", _name(table), c(field)))
    services, events = t["services"], t["events"]
    out += [
        failing(t["contexts"], c("slug") == c("id"), "context-slug", c("id"), c("slug")),
        failing(services, c("id") == F.concat("context", F.lit("."), "slug"), "service-id", c("id"), F.concat("context", F.lit("."), "slug")),
        duplicates(services, ["context", "slug"], "service-slug-twice"),
        failing(t["externals"], ~c("id").contains(".") & (c("id") == c("slug")), "external-id", c("id"), c("slug")),
        failing(t["externals"].join(t["contexts"].select("id"), "id", "left_semi"), F.lit(False), "external-is-context", c("id"), c("id")),
        _lost(services.select("id", F.explode("dependsOn").alias("ref")), "ref", services, "id", "dependency-unknown", c("id")),
        failing(services.select("id", F.explode("dependsOn").alias("ref")).where("id = ref"), F.lit(False), "dependency-on-itself", c("id"), c("ref")),
        _lost(services.select("id", F.explode("stores").alias("ref")), "ref", t["stores"], "id", "service-store-unknown", c("id")),
        failing(t["channels"], F.coalesce(F.trim("address"), F.lit("")) != "", "channel-without-address", c("service"), c("kind")),
        failing(t["channel_messages"], F.coalesce(F.trim("name"), F.lit("")) != "", "message-without-name", F.concat_ws("/", "service", "address"), c("direction")),
        failing(t["aggregates"], F.coalesce("root", F.lit("")) != "", "aggregate-without-root", c("id"), c("name")),
        failing(events.join(t["event_versions"].select(c("event").alias("id")), "id", "left_anti"), F.lit(False), "event-without-version", c("id"), c("name")),
        failing(events.where("wire is not null"), F.coalesce("wire.name", F.lit("")) != "", "wire-without-name", c("id"), c("wire.channel")),
        duplicates(t["event_versions"], ["event", "version"], "event-version-twice"),
        _lost(t["operations"].select("id", F.explode("emits").alias("ref")), "ref", events, "id", "operation-emits-unknown", c("id")),
        _lost(t["operations"].select("id", "service", F.explode("exposedBy").alias("_m")).withColumn("ref", F.concat("service", F.lit(" "), "_m")), "ref", t["methods"].select(F.concat("service", F.lit(" "), "interface", F.lit("/"), "name").alias("m")), "m", "operation-exposed-by-unknown", c("id")),
        failing(t["transitions"], F.coalesce("on", F.lit("")) != "", "transition-on-nothing", c("aggregate"), F.concat_ws(" to ", "from", "to")),
        _lost(t["transitions"], "emits", events, "id", "transition-emits-unknown", c("aggregate")),
    ]
    stores, relations, columns = t["stores"], t["relations"], t["columns"]
    column_id = F.concat("relation", F.lit("."), "name")
    known_columns = columns.select(column_id.alias("id"))
    foreign = columns.where("fk is not null").withColumn("_table", c("fk.table")).withColumn("_column", F.concat("fk.table", F.lit("."), "fk.column"))
    derived = columns.select(column_id.alias("id"), "relation_kind", F.explode("from").alias("ref"))
    out += [
        _lost(stores, "owner", services, "id", "store-owner-unknown", c("id")),
        failing(stores.where("owner <> ''"), c("id") == F.concat("owner", F.lit("."), "slug"), "store-id", c("id"), F.concat("owner", F.lit("."), "slug")),
        failing(relations, c("id") == F.concat("store", F.lit("."), "name"), "relation-id", c("id"), F.concat("store", F.lit("."), "name")),
        duplicates(relations, ["id"], "relation-twice"),
        duplicates(columns, ["relation", "name"], "column-twice"),
        _lost(foreign, "_table", relations, "id", "foreign-key-table-unknown", column_id),
        _lost(foreign.join(relations.select(c("id").alias("_table")).distinct(), "_table", "left_semi"), "_column", known_columns, "id", "foreign-key-column-unknown", column_id),
        _lost(derived, "ref", known_columns, "id", "lineage-unknown", c("id")),
        failing(derived.where("id = ref"), F.lit(False), "lineage-to-itself", c("id"), c("ref")),
        failing(columns.where("relation_kind = 'view'"), c("fk").isNull() & ~F.coalesce("pk", F.lit(False)), "view-with-key", column_id, c("name")),
        _lost(relations.select("id", F.explode("reads").alias("ref")), "ref", relations, "id", "view-reads-unknown", c("id")),
        _lost(relations.withColumn("ref", c("persists.aggregate")), "ref", t["aggregates"], "id", "persists-unknown-aggregate", c("id")),
        _lost(relations.withColumn("ref", c("persists.block")), "ref", t["blocks"], "id", "persists-unknown-block", c("id")),
    ]
    nodes, lanes = t["flow_nodes"], t["participants"].select(F.concat_ws("/", "flow", "id").alias("lane"))
    steps = nodes.where("type = 'step'")
    step = F.concat_ws("/", "flow_id", "node_id")
    branches = nodes.where("parent_id is not null").groupBy("flow_id", F.col("parent_id").alias("node_id")).agg(F.count_distinct("branch").alias("_branches"))
    contexts = t["contexts"].select("id").unionByName(services.select("id"))
    out += [
        failing(t["flows"], F.coalesce("owner", F.lit("")) != "", "flow-without-owner", c("id"), c("slug")),
        _lost(t["flows"], "owner", contexts, "id", "flow-owner-unknown", c("id")),
        duplicates(t["participants"], ["flow", "id"], "lane-twice"),
        duplicates(steps, ["flow_id", "node_id"], "step-twice"),
        _lost(steps.withColumn("_l", F.concat_ws("/", "flow_id", "from")), "_l", lanes, "lane", "step-from-unknown-lane", step),
        _lost(steps.withColumn("_l", F.concat_ws("/", "flow_id", "to")), "_l", lanes, "lane", "step-to-unknown-lane", step),
        failing(steps, c("kind").isin("rpc", "event", "call", "response"), "step-kind-unknown", step, c("kind")),
        failing(nodes.where("type = 'alt'").join(branches, ["flow_id", "node_id"], "left"), c("_branches") >= 2, "choice-of-one", step, c("_branches")),
        failing(t["deployments"], F.coalesce("name", F.lit("")) != "", "deployment-without-name", c("id"), c("environment")),
        _lost(t["modules"], "owner", services, "id", "module-owner-unknown", c("id")),
        failing(t["terms"], F.coalesce("definition", F.lit("")) != "", "term-without-definition", c("id"), c("name")),
        _lost(t["terms"], "context", t["contexts"], "id", "term-context-unknown", c("id")),
        duplicates(t["terms"], ["context", "slug"], "term-twice"),
        failing(t["adrs"].where("date is not null"), F.try_to_timestamp("date").isNotNull(), "decision-date-unreadable", c("id"), c("date")),
        *[_lost(t[name].select("id", F.coalesce("scope.context", "scope.service").alias("ref")), "ref", contexts, "id", f"{word}-scope-unknown", c("id")) for name, word in (("adrs", "decision"), ("rfcs", "proposal"))],
    ]
    text = lambda name: F.coalesce(F.trim(name), F.lit("")) != ""
    targets = services.select(F.lit("service").alias("kind"), "id").unionByName(t["flows"].select(F.lit("flow").alias("kind"), "id")).unionByName(t["adrs"].select(F.lit("adr").alias("kind"), "id")).unionByName(t["rfcs"].select(F.lit("rfc").alias("kind"), "id"))
    targets = targets.unionByName(steps.select(F.lit("step").alias("kind"), F.col("node_id").alias("id"))).select(F.concat_ws(" ", "kind", "id").alias("_t"))
    links = t["workItemLinks"].withColumn("_target", F.concat_ws(" ", "target.kind", "target.id"))
    out += [
        failing(t["repos"], text("commit"), "repository-without-commit", c("repo"), c("path")),
        duplicates(t["repos"], ["repo"], "repository-twice"),
        failing(t["workItems"], F.coalesce(c("url"), F.lit("")).rlike("^https?://"), "work-item-without-address", c("id"), c("url")),
        _lost(links, "workItem", t["workItems"], "id", "work-item-unknown", c("workItem")),
        _lost(links, "_target", targets, "_t", "work-item-target-unknown", c("workItem")),
        failing(links, c("basis").isin("declared", "source-file", "service-directory"), "work-item-basis-unknown", c("workItem"), c("basis")),
        failing(t["rfcs"], text("displayId"), "proposal-without-name", c("id"), c("title")),
        failing(t["rfcs"], c("lifecycle").isin(*LIFECYCLES), "proposal-lifecycle-unknown", c("id"), c("lifecycle")),
        *[
            _lost(t["decision_links"].where((c("record") == record) & (c("kind") == kind)), "ref", known, "id", f"{word}-relates-unknown", c("id"))
            for record, word in (("adr", "decision"), ("rfc", "proposal")) for kind, known in (("service", services), ("event", events), ("flow", t["flows"]))
        ],
        _lost(t["adrs"], "supersededBy", t["adrs"], "id", "decision-superseded-by-unknown", c("id")),
        failing(t["specs"], text("title"), "specification-without-title", c("id"), c("slug")),
        failing(t["requirements"], text("title"), "requirement-without-title", F.concat_ws("/", "spec", "id"), c("text")),
        duplicates(t["requirements"], ["spec", "id"], "requirement-twice"),
        failing(t["scenarios"], (F.coalesce(F.size("when"), F.lit(0)) > 0) & (F.coalesce(F.size("then"), F.lit(0)) > 0), "scenario-without-steps", F.concat_ws("/", "requirement", "name"), c("spec")),
        duplicates(t["tasks"], ["spec", "id"], "task-twice"),
        failing(t["tasks"], text("title"), "task-without-title", F.concat_ws("/", "spec", "id"), c("source")),
        _lost(t["configurationBindings"], "service", services, "id", "binding-of-unknown-service", F.concat_ws("|", "service", "environment", "variable")),
        failing(t["configurationBindings"], c("value").isNull() | c("secretRef").isNull(), "binding-of-value-and-secret", F.concat_ws("|", "service", "environment", "variable"), c("source")),
        _lost(t["transitions"].select("aggregate", F.concat_ws(" ", "aggregate", "from").alias("ref")).unionByName(t["transitions"].select("aggregate", F.concat_ws(" ", "aggregate", "to").alias("ref"))), "ref", t["states"].select(F.concat_ws(" ", "aggregate", "state").alias("s")), "s", "transition-of-unknown-state", c("aggregate")),
        failing(t["def_fields"], text("name"), "definition-field-without-name", c("def"), c("type")),
        duplicates(t["def_fields"], ["def", "name"], "definition-field-twice"),
    ]
    return violations(*out)


def summary(found: DataFrame) -> DataFrame:
    """Violations by rule, most first; ties by name."""
    return found.groupBy("rule").agg(F.count("*").alias("rows"), F.min("subject").alias("example")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rows"), "rule")))
