"""The flat rows that rules read: one table per subject, with all joins already made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasframe.functions.text import abbreviations
from atlasframe.operators.shapes import field_differences, types_disagree
from atlasframe.operators.usages import drift_texts
from atlasframe.plans.rules import Rule, evaluate



def _none() -> Column:
    return F.array().cast("array<string>")


def _set(c: Column) -> Column:
    return F.array_sort(F.collect_set(c))


def subjects(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Merged tables to subject rows. Lists are sorted; absent counts are 0."""
    out: dict[str, DataFrame] = {}
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    count = lambda df, name, cond=None: df.groupBy("service").agg((F.count("*") if cond is None else F.count_if(cond)).alias(name))
    service = t["services"].withColumnRenamed("id", "service")
    for part in (
        count(t["interfaces"], "provides"), count(t["methods"], "methods"), count(t["calls"], "calls"), count(t["calls"], "unresolvedCalls", F.col("status") == "unresolved"),
        count(t["aggregates"], "aggregates"), count(t["events"], "events"), t["channels"].groupBy("service").agg(_set(F.col("address")).alias("channels")),
    ):
        service = service.join(part, "service", "left")
    short = abbreviations(F.coalesce("name", F.lit("")))
    service = service.withColumn("_short", short)
    unknown = service.select("service", F.explode("_short").alias("name")).join(t["terms"].select("name").distinct(), "name", "left_anti").groupBy("service").agg(F.array_sort(F.collect_set("name")).alias("_unknown"))
    service = service.join(unknown, "service", "left")
    out["service"] = service.select(
        F.col("service").alias("id"), "slug", "name", "context", "kind", "repo", "path", F.coalesce("technologies", _none()).alias("technologies"), (F.trim(F.coalesce("readme", F.lit(""))) != "").alias("hasReadme"),
        F.col("_short").alias("abbreviations"), F.coalesce("_unknown", _none()).alias("unexplainedAbbreviations"), F.coalesce("owners", _none()).alias("owners"), zero("provides"), zero("methods"), zero("calls"), zero("unresolvedCalls"),
        zero("aggregates"), zero("events"), F.coalesce("stores", _none()).alias("stores"), F.coalesce("channels", _none()).alias("channels"), F.coalesce("hosts", _none()).alias("hosts"), F.coalesce("dials", _none()).alias("dials"),
    )

    methods = t["methods"].select(F.col("service").alias("peer"), F.concat("interface", F.lit("/"), "name").alias("id")).distinct().withColumn("_declared", F.lit(True))
    peers = t["services"].select(F.col("id").alias("peer")).unionByName(t["externals"].select(F.col("id").alias("peer"))).distinct().withColumn("_known", F.lit(True))
    call = t["calls"].join(methods, ["peer", "id"], "left").join(peers, "peer", "left")
    out["call"] = call.select(
        "id", F.substring_index("id", "/", 1).alias("interface"), F.substring_index("id", "/", -1).alias("method"), "peer", "status", (F.col("status") != "unresolved").alias("resolved"), F.col("_known").isNotNull().alias("peerKnown"),
        F.col("_declared").isNotNull().alias("methodDeclared"), "service", "context", "note",
    )

    cons = t["consumers"].groupBy("event").agg(_set(F.col("consumer")).alias("consumers"), F.count_if(F.col("status") == "unresolved").alias("unresolvedConsumers"))
    sends = t["channel_messages"].where("direction = 'send'").groupBy("service").agg(_set(F.col("address")).alias("declaredChannels"))
    versions = t["event_versions"].groupBy("event").agg(F.count("*").alias("versions"), F.max_by("deprecated", "version").alias("deprecated"))
    event = t["events"].drop("versions", "consumers").withColumnRenamed("id", "event").join(cons, "event", "left").join(versions, "event", "left").join(sends, "service", "left")
    out["event"] = event.select(
        F.col("event").alias("id"), "slug", "name", "aggregate", "service", "context", zero("versions"), F.coalesce("deprecated", F.lit(False)).alias("deprecated"), F.coalesce("consumers", _none()).alias("consumers"), zero("unresolvedConsumers"),
        F.coalesce("wire.name", F.lit("")).alias("wireName"), F.coalesce("wire.channel", F.lit("")).alias("channel"), F.coalesce("declaredChannels", _none()).alias("declaredChannels"),
    )
    out["consumer"] = t["consumers"].select("event", F.substring_index("event", ".", -1).alias("name"), "aggregate", F.col("service").alias("owner"), "context", "consumer", "status", (F.col("status") != "unresolved").alias("resolved"), "note", F.concat_ws(" <- ", "event", "consumer").alias("id"))

    own_events = t["events"].where("wire.channel is not null").groupBy("service", F.col("wire.channel").alias("address")).agg(_set(F.col("name")).alias("events"), F.first("context").alias("_context"))
    messages = t["channel_messages"].groupBy("service", "address").agg(_set(F.when(F.col("direction") == "send", F.col("name"))).alias("sends"), _set(F.when(F.col("direction") == "receive", F.col("name"))).alias("receives"))
    declared = t["channels"].select("service", "address", "context", "kind", "protocol", "title").withColumn("declared", F.lit(True))
    channel = declared.join(messages, ["service", "address"], "left").join(own_events, ["service", "address"], "full_outer")
    publishes = (F.size(F.coalesce("sends", _none())) > 0) | F.col("events").isNotNull()
    channel = channel.withColumn("publishes", publishes)
    publishers = channel.where("publishes").groupBy("address").agg(_set(F.col("service")).alias("_all"))
    protocols = t["channels"].where("protocol <> ''").groupBy("address").agg(F.min("protocol").alias("_protocol"))
    channel = channel.join(publishers, "address", "left").join(protocols, "address", "left")
    out["channel"] = channel.select(
        "address", F.coalesce("kind", F.lit("event")).alias("kind"), F.coalesce("_protocol", F.lit("")).alias("protocol"), "title", "service", F.coalesce("context", "_context").alias("context"), F.coalesce("declared", F.lit(False)).alias("declared"), "publishes",
        F.coalesce("sends", _none()).alias("sends"), F.coalesce("receives", _none()).alias("receives"), F.coalesce("events", _none()).alias("events"), F.array_except(F.coalesce("_all", _none()), F.array("service")).alias("otherPublishers"), F.concat_ws(" @ ", "service", "address").alias("id"),
    )

    sent = t["channel_messages"].where("direction = 'send'").select("address", "name", F.col("service").alias("_by"), F.col("encoding").alias("_enc"))
    sent = sent.unionByName(t["events"].where("wire.channel is not null").select(F.col("wire.channel").alias("address"), F.col("wire.name").alias("name"), F.col("service").alias("_by"), F.lit(None).cast("string").alias("_enc")))
    heard = t["channel_messages"].where("direction = 'receive'").join(sent, ["address", "name"], "left").groupBy("service", "context", F.col("address").alias("channel"), "kind", "name", "encoding").agg(
        _set(F.col("_by")).alias("publishers"), _set(F.when((F.col("_enc") != F.col("encoding")) & (F.col("encoding") != ""), F.col("_by"))).alias("mismatched")
    )
    out["subscription"] = heard.withColumn("published", F.size("publishers") > 0).withColumn("id", F.concat_ws(" <- ", "service", F.concat_ws("#", "channel", "name")))

    owner = t["aggregates"].select(F.col("id").alias("_agg"), F.col("service").alias("aggregateOwner"))
    columns = t["columns"]
    stats = columns.groupBy("relation").agg(F.count_if(F.col("maps").isNotNull()).alias("mappedColumns"), _set(F.col("name")).alias("column_names"), F.bool_or(F.lower("type").rlike("^(json|jsonb|bytea|blob|text)")).alias("hasPayload"))
    acc = t["accesses"].groupBy("relation").agg(*[F.count_if(F.col("operation") == o).alias(n) for o, n in (("read", "reads"), ("write", "writes"), ("delete", "deletes"))])
    rel_owner = t["relations"].select(F.col("id").alias("_rel"), F.col("owner").alias("_rel_owner")).distinct()
    reads = t["relations"].select(F.col("id").alias("relation"), F.col("owner").alias("_me"), F.explode("reads").alias("_rel")).join(rel_owner, "_rel").where("_rel_owner <> _me").groupBy("relation").agg(_set(F.col("_rel")).alias("foreignReads"))
    table = t["relations"].withColumnRenamed("reads", "_reads").withColumn("relation", F.col("id")).withColumn("_agg", F.col("persists.aggregate")).join(owner, "_agg", "left").join(stats, "relation", "left").join(acc, "relation", "left").join(reads, "relation", "left")
    out["table"] = table.select(
        "id", "name", F.col("relation_kind").alias("kind"), "store", F.col("store_kind").alias("storeKind"), "owner", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("_agg", F.lit("")).alias("aggregate"), F.coalesce("aggregateOwner", F.lit("")).alias("aggregateOwner"),
        zero("mappedColumns"), F.coalesce("column_names", _none()).alias("columns"), F.coalesce("foreignReads", _none()).alias("foreignReads"), F.coalesce("hasPayload", F.lit(False)).alias("hasPayload"), zero("reads"), zero("writes"), zero("deletes"),
    )

    col_id = F.concat("relation", F.lit("."), "name")
    fk = rel_owner.withColumnRenamed("_rel", "_fk").withColumnRenamed("_rel_owner", "fkOwner")
    froms = columns.select(col_id.alias("id"), F.col("owner").alias("_me"), F.explode("from").alias("_f")).withColumn("_rel", F.regexp_replace("_f", r"\.[^.]*$", "")).join(rel_owner, "_rel").where("_rel_owner <> _me")
    froms = froms.groupBy("id").agg(_set(F.col("_f")).alias("foreignFrom"), _set(F.col("_rel_owner")).alias("foreignOwners"))
    out["column"] = columns.withColumn("id", col_id).withColumn("_fk", F.col("fk.table")).join(fk, "_fk", "left").join(froms, "id", "left").select(
        "id", "name", "relation", F.col("relation_kind").alias("kind"), "store", "owner", "type", F.coalesce("nullable", F.lit(False)).alias("nullable"), F.coalesce("pk", F.lit(False)).alias("pk"), F.coalesce("_fk", F.lit("")).alias("fk"),
        F.coalesce("fkOwner", F.lit("")).alias("fkOwner"), F.coalesce("from", _none()).alias("from"), F.coalesce("foreignFrom", _none()).alias("foreignFrom"), F.coalesce("foreignOwners", _none()).alias("foreignOwners"), F.coalesce("maps", F.lit("")).alias("maps"),
    )

    # Columns that claim a field of the persisted model, and whether the model has it.
    fields = t["blocks"].select(F.col("aggregate").alias("_agg"), F.col("name").alias("_type"), F.explode("fields").alias("_f")).select("_agg", "_type", F.col("_f.name").alias("_field"), F.col("_f.type").alias("fieldType"))
    claims = columns.where("maps is not null and aggregate is not null").select(F.concat("relation", F.lit("."), "name").alias("id"), "relation", F.col("aggregate").alias("_agg"), F.substring_index("maps", ".", 1).alias("_type"), F.get(F.split("maps", r"\."), F.lit(1)).alias("_field"), "type")
    claimed = claims.join(fields, ["_agg", "_type", "_field"], "left")
    matches = claimed.groupBy("id").agg(F.first("fieldType").alias("fieldType"), F.bool_or(F.coalesce(types_disagree(F.col("type"), F.col("fieldType")), F.lit(False))).alias("_bad"))
    out["column"] = out["column"].join(matches, "id", "left").withColumn("typeMatches", ~F.coalesce("_bad", F.lit(False))).drop("_bad")
    modelled = fields.select("_agg").distinct().withColumn("_modelled", F.lit(True))
    held = claimed.join(modelled, "_agg", "left_semi").groupBy(F.col("relation").alias("id")).agg(F.count("*").alias("claimedColumns"), F.count("fieldType").alias("heldColumns"))
    out["table"] = out["table"].join(held, "id", "left").withColumn("claimedColumns", F.coalesce("claimedColumns", F.lit(0))).withColumn("heldColumns", F.coalesce("heldColumns", F.lit(0)))

    def messages(df: DataFrame) -> DataFrame:
        return df.select("service", F.col("id").alias("interface"), F.explode("messages").alias("_m")).select("service", "interface", F.col("_m.name").alias("message"), F.explode("_m.fields").alias("_f")).select("service", "interface", "message", F.col("_f.name").alias("field"), F.col("_f.type").alias("type"))

    copies = t["copies"].select("service", "context", F.col("id").alias("interface"), "source")
    given = t["interfaces"].groupBy(F.col("id").alias("interface")).agg(F.count_distinct("service").alias("_n"), F.min("service").alias("provider")).where("_n = 1").drop("_n")
    copies = copies.join(given, "interface").where("provider <> service").withColumn("copy", F.concat_ws(" < ", "interface", "service"))
    mine = copies.select("copy", "service", "interface").join(messages(t["copies"]), ["service", "interface"])
    theirs = copies.select("copy", F.col("provider").alias("service"), "interface").join(messages(t["interfaces"]), ["service", "interface"])
    out["copy"] = copies.join(field_differences(mine, theirs), "copy", "left").select(F.col("copy").alias("id"), "service", "context", "provider", F.coalesce("differences", _none()).alias("differences"), "source")

    exposed = t["operations"].select("aggregate", F.size(F.coalesce("exposedBy", _none())).alias("_e"), "kind")
    per = exposed.groupBy(F.col("aggregate").alias("id")).agg(F.count_if(F.col("kind") == "command").alias("commands"), F.count_if(F.col("kind") == "query").alias("queries"), F.count_if(F.col("_e") == 0).alias("unexposed"))
    made = t["events"].groupBy(F.col("aggregate").alias("id")).agg(F.count("*").alias("events"))
    out["aggregate"] = t["aggregates"].join(per, "id", "left").join(made, "id", "left").select("id", "slug", "name", "root", "service", "context", zero("commands"), zero("queries"), zero("unexposed"), zero("events"))
    out["operation"] = t["operations"].select(F.concat_ws("#", "aggregate", "id").alias("id"), F.col("id").alias("name"), "kind", "aggregate", "service", "context", F.coalesce("exposedBy", _none()).alias("exposedBy"), F.coalesce("emits", _none()).alias("emits"))

    by_path = t["services"].where("repo <> '' and path <> ''").groupBy("repo", "path").agg(F.count("*").alias("_n"), F.first("id").alias("_placed")).where("_n = 1").drop("_n")
    named = t["services"].select(F.col("id").alias("service"), F.lit(True).alias("_named"))
    out["deployment"] = t["deployments"].join(by_path, ["repo", "path"], "left").join(named, "service", "left").select(
        "id", "name", "environment", "cluster", "namespace", "repo", "path", F.coalesce(F.when(F.col("_named"), F.col("service")), "_placed", F.lit("")).alias("service"),
        (F.col("_named").isNotNull() | F.col("_placed").isNotNull()).alias("claimed"), "basis", (F.size(drift_texts()) > 0).alias("drifted"), F.array_join(drift_texts(), "; ").alias("drift"),
    )

    lanes = t["participants"].select(F.col("flow").alias("flow_id"), F.col("id").alias("_lane"), F.col("context").alias("_ctx"))
    steps = t["flow_nodes"].where("type = 'step'").join(lanes.withColumnsRenamed({"_lane": "from", "_ctx": "_a"}), ["flow_id", "from"], "left").join(lanes.withColumnsRenamed({"_lane": "to", "_ctx": "_b"}), ["flow_id", "to"], "left")
    crossing = (F.col("_a") != F.col("_b")) & F.col("ref").isNull()
    per = steps.groupBy(F.col("flow_id").alias("id")).agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "unresolved").alias("unresolvedSteps"), F.count_if(F.col("status") == "verified").alias("verifiedSteps"), F.count_if(crossing).alias("uncontractedCrossings"))
    out["flow"] = t["flows"].select("id", "slug", "name", "summary", "owner", F.coalesce("entrypoint", F.lit("")).alias("trigger")).join(per, "id", "left").select("id", "slug", "name", "summary", "owner", "trigger", zero("steps"), zero("unresolvedSteps"), zero("verifiedSteps"), zero("uncontractedCrossings"))
    return out


#: Ids, subjects and grades of the built-in rules; conditions over the fields above.
BUILTIN = [
    Rule("rpc", "call", "!resolved", '"call " + id + " to " + peer + " is unresolved"', "warning"),
    Rule("consumer", "consumer", "!resolved", '"consumer " + consumer + " of " + event + " is unresolved"', "warning"),
    Rule("proto-missing", "call", "resolved && peerKnown && !methodDeclared", 'peer + " does not declare " + id', "error"),
    Rule("shared-channel", "channel", "publishes && size(otherPublishers) > 0", '"several services publish to " + address', "error"),
    Rule("channel-undeclared", "event", 'channel != "" && size(declaredChannels) > 0 && !(channel in declaredChannels)', 'id + " goes to undeclared " + channel', "warning"),
    Rule("channel-unpublished", "channel", 'declared && kind == "event" && size(sends) > 0 && size(events) == 0', 'address + " is declared, and no event names it"', "warning"),
    Rule("channel-transport-unknown", "channel", 'protocol == ""', 'address + " has no transport"', "warning"),
    Rule("subscription-unresolved", "subscription", "!published", 'name + " on " + channel + " has no publisher"', "warning"),
    Rule("message-encoding", "subscription", "size(mismatched) > 0", 'name + " is sent in another encoding"', "error"),
    Rule("cross-service-fk", "column", 'fkOwner != "" && fkOwner != owner', 'id + " refers to a table of " + fkOwner', "error"),
    Rule("cross-service-lineage", "column", "size(foreignFrom) > 0", 'id + " is filled from another service"', "warning"),
    Rule("cross-service-view", "table", 'kind == "view" && size(foreignReads) > 0', 'id + " reads relations of another service"', "error"),
    Rule("shared-store", "table", 'aggregateOwner != "" && aggregateOwner != owner && role != "projection"', 'id + " persists a model of " + aggregateOwner', "error"),
    Rule("proto-drift", "copy", "size(differences) > 0", 'id + " differs from what " + provider + " publishes"', "error"),
    Rule("persistence-drift", "table", "claimedColumns > heldColumns", 'id + " claims fields that its model has not"', "warning"),
    Rule("column-type", "column", "!typeMatches", 'id + " is " + type + ", its field " + fieldType', "warning"),
    Rule("outbox-payload", "table", 'role == "outbox" && !hasPayload', 'id + " has no payload column"', "warning"),
    Rule("deployment-unclaimed", "deployment", "!claimed", 'name + " belongs to no service"', "warning"),
    Rule("deployment-drift", "deployment", "drifted", 'name + ": " + drift', "warning"),
    Rule("service-stack-unknown", "service", "size(technologies) == 0", 'id + " names no technology"', "info"),
    Rule("service-undescribed", "service", "!hasReadme", 'id + " has no description"', "info"),
    Rule("service-abbreviation-unexplained", "service", "size(unexplainedAbbreviations) > 0", 'id + " has an unexplained name"', "info"),
    Rule("flow-trigger-missing", "flow", 'trigger == ""', 'id + " has no trigger"', "info"),
    Rule("flow-summary-empty", "flow", 'summary == ""', 'id + " has no summary"', "info"),
    Rule("flow-step-unresolved", "flow", "unresolvedSteps > 0", 'id + " has unresolved steps"', "warning"),
    Rule("flow-crossing-uncontracted", "flow", "uncontractedCrossings > 0", 'id + " crosses contexts without a contract"', "warning"),
    Rule("flow-observed-coverage-low", "flow", "steps > 0 && verifiedSteps * 2 < steps", 'id + " is seen running for less than half of its steps"', "info"),
]


def problems(rows: dict[str, DataFrame], rules: list[Rule], conflicts: DataFrame | None = None) -> DataFrame:
    """All problems of all subjects; merge conflicts are problems of the rule ``merge-conflict``."""
    out = None
    for name, df in rows.items():
        if any(r.over == name for r in rules):
            found = evaluate(df, name, rules, "id")[0]
            out = found if out is None else out.unionByName(found)
    if conflicts is not None:
        lost = conflicts.select(F.lit("merge-conflict").alias("rule"), F.lit("error").alias("severity"), F.lit(False).alias("disabled"), F.col("where").alias("subject"), "message")
        out = lost if out is None else out.unionByName(lost)
    return out
