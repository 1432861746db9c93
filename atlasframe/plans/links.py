"""Links of merged tables that other sources prove: addresses that configuration sets, providers of HTTP calls, methods that flows serve, accesses of stores, entities behind lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasframe.operators import estate
from atlasframe.operators.resolve import route_shape, suffixes_of
from atlasframe.plans.checkpoints import checkpoint

RAW = r"^http-client/([A-Z]+)\s+(/\S*)(?: @ .+)?$"
URL = r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)(?::[0-9]+)?([^?#]*)"


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def configured_channels(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``channels`` and their ``channel_messages`` at the address that configuration gives the channel's variable, if all environments give the same; ``addresses``: what each of them gives."""
    bound = t["channels"].withColumn("variable", F.col("addressBinding.environmentVariable")).withColumn("_declared", F.col("address"))
    found = estate.configured_addresses(bound, t["configurationBindings"])
    moved = found.where("address <> _declared").select("service", F.col("_declared").alias("address"), F.col("address").alias("_now"))
    messages = t["channel_messages"].join(moved, ["service", "address"], "left").withColumn("address", F.coalesce("_now", "address"))
    return {"channels": found.select(*t["channels"].columns, "addresses"), "channel_messages": messages.select(*t["channel_messages"].columns)}


def http_providers(t: dict[str, DataFrame]) -> DataFrame:
    """Routes whose verb is known: provider, ref, verb, route, shape, inferred (the verb is a reading)."""
    http = F.col("http")
    rows = t["methods"].where(_given(http["method"]).isNotNull()).select(
        F.col("service").alias("provider"), F.concat("interface", F.lit("/"), "name").alias("ref"), F.upper(http["method"]).alias("_verb"), F.coalesce(http["path"], F.lit("")).alias("route"), F.coalesce(http["methodBasis"] == "inferred", F.lit(False)).alias("inferred")
    )
    return rows.withColumn("_full", route_shape(F.col("route"))).dropDuplicates(["provider", "ref"])


def resolved_calls(t: dict[str, DataFrame]) -> DataFrame:
    """Unresolved HTTP calls with their one provider: service, id, provider, ref, route, basis, inferred; those without or with several are left out.

    The address that configuration gives the call's variable decides if all environments lead to one method (basis ``deployment-config``: the verb and the whole path are equal;
    of several such methods, the one that answers on the host). Else the whole path, if the call has it (``full-path``), or the route in its id, of which an equal one (``exact-route``) goes
    before one that ends so (``unique-suffix``). Of several providers, the one that answers on the host that the call names, or, without a host, on one that the caller dials
    (``kubernetes-host``). No service calls itself. A verb ``HTTP`` is one not known, which any fits.
    """
    key, call = ["service", "id"], F.col("destination")
    raw = lambda n: _given(F.regexp_extract("id", RAW, n))
    opened = t["calls"].where("status = 'unresolved'").groupBy(*key).agg(F.min("destination").alias("destination"))
    opened = opened.withColumn("_whole", _given(call["fullPath"]).isNotNull()).withColumn("_path", F.coalesce(_given(call["fullPath"]), raw(2)))
    verb = F.upper(F.when(F.col("_whole"), call["method"]).otherwise(raw(1)))
    opened = opened.withColumn("_asked", F.when(verb.isin("", "HTTP"), None).otherwise(verb)).withColumn("_host", estate.call_host(call["serviceDiscoveryAlias"], call["baseURL"]["value"], F.col("id")))
    known = http_providers(t)
    names = t["services"].select(F.col("id").alias("provider"), "hosts")

    bindings = t["configurationBindings"].where(_given(F.col("value")).isNotNull()).select("service", "environment", F.col("variable").alias("_variable"), "value")
    set_ = opened.withColumn("_variable", call["baseURL"]["environmentVariable"]).join(bindings, ["service", "_variable"])
    local = F.coalesce(call["localPath"], raw(2), F.lit(""))
    set_ = set_.select(*key, "environment", "value", F.upper(call["method"]).alias("_verb"), _given(F.lower(F.regexp_extract("value", URL, 1))).alias("_at"), route_shape(F.concat(F.regexp_extract("value", URL, 2), F.lit("/"), local)).alias("_full"))
    fits = set_.join(known.where("provider is not null"), ["_verb", "_full"], "left").join(names, "provider", "left")
    fits = fits.withColumn("_ok", F.col("provider").isNotNull() & (F.col("provider") != F.col("service")) & F.col("_at").isNotNull()).withColumn("_named", F.col("_ok") & F.coalesce(estate.answers_on(F.col("provider"), F.col("hosts"), F.col("_at")), F.lit(False)))
    hit = F.struct("provider", "ref", "route", "inferred")
    each = fits.groupBy(*key, "environment", "value").agg(F.count_if("_ok").alias("_n"), F.count_if("_named").alias("_m"), F.min(F.when(F.col("_ok"), hit)).alias("_any"), F.min(F.when(F.col("_named"), hit)).alias("_one"))
    each = each.select(*key, F.when(F.col("_m") == 1, F.col("_one")).when((F.col("_m") == 0) & (F.col("_n") == 1), F.col("_any")).alias("_hit"))
    sure = each.groupBy(*key).agg(F.bool_and(F.col("_hit").isNotNull()).alias("_all"), F.count_distinct("_hit").alias("_n"), F.min("_hit").alias("_hit")).where("_all and _n = 1")
    sure = sure.select(*key, "_hit.*", F.lit("deployment-config").alias("basis"))

    served = known.withColumn("_shape", F.explode(F.array_distinct(suffixes_of(F.col("_full")))))
    rest = opened.join(sure, key, "left_anti").where("_path is not null").withColumn("_shape", route_shape(F.col("_path")))
    found = rest.join(served, "_shape").where("provider <> service and (_asked is null or _asked = _verb) and (not _whole or _full = _shape)").join(names, "provider", "left")
    found = found.join(t["services"].select(F.col("id").alias("service"), "dials"), "service", "left")
    there = lambda host: F.coalesce(estate.answers_on(F.lit(""), F.col("hosts"), host), F.lit(False))
    dialled = F.exists(F.coalesce("dials", F.array().cast("array<string>")), there)
    found = found.withColumn("_exact", F.col("_full") == F.col("_shape")).withColumn("_reach", F.when(F.col("_host").isNotNull(), there(F.col("_host"))).otherwise(dialled))
    counts = lambda exact: [F.count_if(F.col("_exact") if exact else F.lit(True)).alias(f"_n{exact:d}"), F.count_if(F.col("_reach") & (F.col("_exact") if exact else F.lit(True))).alias(f"_r{exact:d}")]
    firsts = [F.min(F.when(when, hit)).alias(name) for name, when in (("_e", F.col("_exact")), ("_er", F.col("_exact") & F.col("_reach")), ("_s", F.lit(True)), ("_sr", F.col("_reach")))]
    told = found.groupBy(*key, "_whole").agg(*counts(True), *counts(False), *firsts)
    exact = F.col("_n1") > 0
    n, reach = F.when(exact, F.col("_n1")).otherwise(F.col("_n0")), F.when(exact, F.col("_r1")).otherwise(F.col("_r0"))
    one = F.when(n == 1, F.when(exact, F.col("_e")).otherwise(F.col("_s"))).when(reach == 1, F.when(exact, F.col("_er")).otherwise(F.col("_sr")))
    basis = F.when(n > 1, "kubernetes-host").when(F.col("_whole"), "full-path").when(exact, "exact-route").otherwise("unique-suffix")
    return sure.unionByName(told.select(*key, one.alias("_hit"), basis.alias("basis")).where("_hit is not null").select(*key, "_hit.*", "basis"))


def http_calls(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``calls``, ``flow_nodes`` and ``participants`` with the providers of ``resolved_calls``.

    A call becomes one of its provider's method, declared; of several calls of a service that do, or are so already, the least stays, a resolved one last. Steps that made the call go to the
    provider. A lane of unknown kind that all steps have left goes; the provider gets a lane behind the others.
    """
    hits = checkpoint(resolved_calls(t)).select("service", "id", "provider", "ref", "route", "basis", "inferred")
    j = t["calls"].join(hits, ["service", "id"], "left").withColumn("_hit", F.col("provider").isNotNull() & (F.col("status") == "unresolved"))
    resolution = F.struct(F.col("basis"), F.col("provider"), F.col("route"), F.when(F.col("inferred"), "medium").alias("confidence"))
    set_ = {"id": F.col("ref"), "peer": F.col("provider"), "status": F.lit("declared"), "destination": F.coalesce(F.col("destination"), F.from_json(F.lit("{}"), t["calls"].schema["destination"].dataType)).withField("resolution", resolution)}
    new = j.select(*[F.when(F.col("_hit"), set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in t["calls"].columns], "_hit")
    rank = F.struct(F.col("_hit"), F.col("peer"), F.coalesce("source", F.lit("")))
    calls = new.groupBy("service", "id").agg(F.min_by(F.struct(*t["calls"].columns), rank).alias("_r")).select("_r.*")

    moves = hits.select(F.col("service").alias("from"), F.col("id").alias("ref"), F.col("provider").alias("_to"), F.col("ref").alias("_ref"))
    nodes = t["flow_nodes"].join(moves, ["from", "ref"], "left")
    go = F.col("_to").isNotNull() & (F.col("type") == "step") & (F.col("kind") == "rpc")
    moved = nodes.where(go).select(F.col("flow_id").alias("flow"), F.col("to").alias("_left"), "_to").distinct()
    nodes = nodes.withColumn("_go", F.coalesce(go, F.lit(False))).withColumn("to", F.when(F.col("_go"), F.col("_to")).otherwise(F.col("to"))).withColumn("ref", F.when(F.col("_go"), F.col("_ref")).otherwise(F.col("ref"))).withColumn("status", F.when(F.col("_go"), "declared").otherwise(F.col("status"))).select(*t["flow_nodes"].columns)
    used = nodes.where("type = 'step'").select(F.col("flow_id").alias("flow"), F.explode(F.array("from", "to")).alias("id")).distinct().withColumn("_used", F.lit(True))
    lanes = t["participants"].join(moved.select("flow", F.col("_left").alias("id"), F.lit(True).alias("_was")).distinct(), ["flow", "id"], "left").join(used, ["flow", "id"], "left")
    lanes = lanes.where("not (kind = 'unknown' and coalesce(_was, false) and _used is null)").select(*t["participants"].columns)
    home = t["services"].groupBy(F.col("id")).agg(F.min("context").alias("context"))
    more = moved.select("flow", F.col("_to").alias("id")).distinct().join(lanes.select("flow", "id"), ["flow", "id"], "left_anti").join(home, "id", "left")
    last = lanes.groupBy("flow").agg(F.max("place").alias("_last"))
    more = more.groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("id", "context"))).alias("_new")).join(last, "flow", "left").select("flow", "_last", F.posexplode("_new").alias("_k", "_x"))
    more = more.select("flow", (F.coalesce("_last", F.lit(-1)) + 1 + F.col("_k")).cast("int").alias("place"), F.col("_x.id").alias("id"), F.lit("service").alias("kind"), F.col("_x.context").alias("context"))
    return {"calls": calls, "flow_nodes": nodes, "participants": lanes.unionByName(more, allowMissingColumns=True)}


def served_methods(t: dict[str, DataFrame]) -> DataFrame:
    """``flow_nodes`` in which the opening step of an endpoint's flow names the method that it serves.

    That is a flow with a trigger whose first node is a step without a ref that an actor takes to a service. The method is the service's only one named as the step or the trigger's label (behind its
    last dot sign) is, else the only one of the route that the label spells.
    """
    label = F.trim(F.element_at(F.split(F.coalesce("trigger.label", F.lit("")), "·"), -1))
    route = r"^([A-Z]+)\s+(/\S*)$"
    flows = t["flows"].where("trigger is not null").select(F.col("id").alias("flow_id"), label.alias("_label"))
    actors = t["participants"].where("kind = 'actor'").select(F.col("flow").alias("flow_id"), F.col("id").alias("from")).distinct()
    openings = t["flow_nodes"].where("type = 'step' and ord = 1 and coalesce(ref, '') = ''").join(flows, "flow_id").join(actors, ["flow_id", "from"], "left_semi")
    openings = openings.select("flow_id", F.col("to").alias("service"), F.array_distinct(F.array_compact(F.array(_given(F.col("label")), _given(F.col("_label"))))).alias("_names"), _given(F.regexp_extract("_label", route, 1)).alias("_verb"), route_shape(_given(F.regexp_extract("_label", route, 2))).alias("_shape"))
    methods = t["methods"].select("service", "name", F.concat("interface", F.lit("/"), "name").alias("_id"), F.upper("http.method").alias("_verb"), route_shape(F.col("http.path")).alias("_shape"))
    only = lambda df, name: df.groupBy("flow_id").agg(F.count_distinct("_id").alias("_n"), F.min("_id").alias(name)).where("_n = 1").drop("_n")
    by_name = only(openings.select("flow_id", "service", F.explode("_names").alias("name")).join(methods, ["service", "name"]), "_by_name")
    by_route = only(openings.join(methods.drop("name"), ["service", "_verb", "_shape"]), "_by_route")
    found = openings.select("flow_id").join(by_name, "flow_id", "left").join(by_route, "flow_id", "left").select("flow_id", F.coalesce("_by_name", "_by_route").alias("_served")).where("_served is not null")
    j = t["flow_nodes"].join(found.withColumn("ord", F.lit(1).cast(t["flow_nodes"].schema["ord"].dataType)), ["flow_id", "ord"], "left")
    return j.withColumn("ref", F.coalesce("_served", "ref")).select(*t["flow_nodes"].columns)


def store_accesses(t: dict[str, DataFrame]) -> DataFrame:
    """``flow_nodes`` whose accesses of a store by a method have the operation, key family and source of the store's one access by that method (the name behind the last dot)."""
    tail = lambda c: F.substring_index(c, ".", -1)
    known = t["keyspace_accesses"].where("method <> ''").groupBy(F.col("store").alias("_store"), tail(F.col("method")).alias("_tail")).agg(F.count("*").alias("_n"), F.min(F.struct("operation", "keyspace", "source")).alias("_a")).where("_n = 1").drop("_n")
    access = F.col("storeAccess")
    open_ = (_given(access["method"]).isNotNull()) & (_given(access["operation"]).isNull() | _given(access["keyspace"]).isNull())
    j = t["flow_nodes"].withColumn("_store", F.when(open_, access["store"])).withColumn("_tail", tail(access["method"])).join(known, ["_store", "_tail"], "left")
    full = access.withField("operation", F.col("_a.operation")).withField("keyspace", F.col("_a.keyspace")).withField("source", F.coalesce(_given(F.col("_a.source")), access["source"]))
    return j.withColumn("storeAccess", F.when(F.col("_a").isNotNull(), full).otherwise(access)).select(*t["flow_nodes"].columns)


def linked_lanes(t: dict[str, DataFrame]) -> DataFrame:
    """``participants`` whose store lanes name their store (``entityRef``): the only one that their steps access, if there is such a store; else the one of the lane's id; else the only one that their neighbours own."""
    steps = t["flow_nodes"].where("type = 'step'").select(F.col("flow_id").alias("flow"), "from", "to", F.col("storeAccess.store").alias("store"))
    at = lambda own, other: steps.select("flow", F.col(own).alias("lane"), F.col(other).alias("service"), "store")
    ends = at("from", "to").unionByName(at("to", "from"))
    lanes = t["participants"].where("kind = 'store' and coalesce(entityRef, '') = ''").select("flow", F.col("id").alias("lane")).distinct()
    ends = ends.join(lanes, ["flow", "lane"], "left_semi")
    stores = t["stores"].select(F.col("id").alias("store"), "owner").distinct()
    accessed = ends.where("store is not null").groupBy("flow", "lane").agg(F.count_distinct("store").alias("_n"), F.min("store").alias("store")).where("_n = 1").drop("_n").join(stores.select("store"), "store", "left_semi")
    linked = estate.link_lanes(lanes, accessed.select("flow", "lane", "store"), stores, ends.select("flow", "lane", "service").distinct()).where("store is not null").select("flow", F.col("lane").alias("id"), F.col("store").alias("_store"))
    j = t["participants"].join(linked, ["flow", "id"], "left")
    return j.withColumn("entityRef", F.coalesce(_given(F.col("entityRef")), "_store")).select(*t["participants"].columns)
