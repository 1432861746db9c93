"""Joins over the facts of an estate: workloads and exposures, evidence about methods and calls, flows of several sources, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.resolve import route_shape


def selects(selector: Column, labels: Column) -> Column:
    """Has ``labels`` every key of ``selector`` with its value? An empty selector selects nothing."""
    return (F.coalesce(F.size(selector), F.lit(0)) > 0) & F.coalesce(F.forall(F.map_keys(selector), lambda k: F.try_element_at(labels, k).eqNullSafe(F.try_element_at(selector, k))), F.lit(False))


def selected_workloads(selectors: DataFrame, workloads: DataFrame, scope: list[str]) -> DataFrame:
    """Selectors (``selector`` map) and the workloads (``labels`` map) of their ``scope`` that they select.

    Each selector looks under one of its pairs only, the first in order, so that this is a join by key; the others are tested on what is found.
    """
    pair = F.array_sort(F.map_entries("selector"))[0]
    keyed = selectors.where("size(selector) > 0").withColumn("_pair", pair)
    shown = workloads.select("*", F.explode(F.map_entries("labels")).alias("_pair"))
    return keyed.join(shown, [*scope, "_pair"]).where(selects(F.col("selector"), F.col("labels"))).drop("_pair")


def host_meet(a: Column, b: Column) -> Column:
    """What two host names, either of which may start with ``*.``, have in common: the narrower one; null if nothing."""
    a, b = F.lower(a), F.lower(b)
    covers = lambda wide, narrow: wide.startswith("*.") & narrow.endswith(F.substring(wide, 2, 1 << 20)) & (F.length(narrow) > F.length(wide) - 1)
    return F.when(a == b, a).when(covers(a, b), b).when(covers(b, a), a)


def exposures(routes: DataFrame, listeners: DataFrame, gateway: list[str]) -> DataFrame:
    """Routes on the listeners of their gateway, with the host names that both have.

    ``routes`` and ``listeners`` share the columns ``gateway``; ``route_hosts`` and ``listener_hosts`` are arrays, of which an empty one says all. Rows without any common host are left out.
    """
    both = routes.join(listeners, gateway)
    met = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform("listener_hosts", lambda a: F.transform("route_hosts", lambda b: host_meet(a, b)))))))
    hosts = F.when(F.size("listener_hosts") == 0, F.array_sort("route_hosts")).when(F.size("route_hosts") == 0, F.array_sort("listener_hosts")).otherwise(met)
    everything = (F.size("listener_hosts") == 0) & (F.size("route_hosts") == 0)
    return both.withColumn("hosts", hosts).where(everything | (F.size("hosts") > 0)).drop("route_hosts", "listener_hosts")


def pattern_messages(rules: DataFrame, bus: str, pattern: str) -> DataFrame:
    """What event rules (``pattern``: JSON with lists ``source`` and ``detail-type``) let through: bus, source, message, rules (how many)."""
    read = F.from_json(pattern, "source array<string>, `detail-type` array<string>")
    each = rules.select(bus, F.explode_outer(read["source"]).alias("source"), read["detail-type"].alias("_t")).select(bus, "source", F.explode("_t").alias("message"))
    return each.groupBy(bus, "source", "message").agg(F.count("*").alias("rules"))


def route_strength(verb: Column, basis: Column) -> Column:
    """How much is known of a route: 2 its verb is declared, 1 inferred, 0 unknown."""
    return F.when(F.coalesce(verb, F.lit("")) == "", 0).when(basis == "inferred", 1).otherwise(2)


def strongest_route(methods: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each method, the first source's path, and on that path the verb of the best known route, the first of equals (``path``, ``verb``, ``basis``)."""
    place = F.struct(*order)
    first = methods.where("path is not null").groupBy(*key).agg(F.min_by("path", place).alias("path"))
    best = F.struct((-route_strength(F.col("verb"), F.col("basis"))).alias("_s"), *order)
    return methods.join(first, [*key, "path"]).groupBy(*key, "path").agg(F.min_by("verb", best).alias("verb"), F.min_by("basis", best).alias("basis"))


def fold_spelling(columns: DataFrame, fields: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Names of ``columns`` as the one field of their ``scope`` is spelled that is equal but for case; exact spellings, and names that several fields or none fit, stay."""
    low = F.lower(F.col(name))
    known = fields.select(*scope, F.col(name).alias("_as")).distinct()
    exact = known.select(*scope, F.col("_as").alias(name), F.lit(True).alias("_exact"))
    one = known.groupBy(*scope, F.lower("_as").alias("_low")).agg(F.min("_as").alias("_as"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    out = columns.withColumn("_low", low).join(exact, [*scope, name], "left").join(one, [*scope, "_low"], "left")
    return out.withColumn(name, F.when(F.col("_exact") | F.col("_as").isNull(), F.col(name)).otherwise(F.col("_as"))).select(*columns.columns)


def overlay(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """A second source's steps over the first's: ``key``, accepted, steps.

    Both: ``steps``, an array of (id, seen). The second is accepted if it has the first's steps in their order and nothing else but steps that were
    ``seen``; its steps then stand for the flow. Otherwise, or without a second source, the first's stay.
    """
    theirs = incoming.select(*key, F.col("steps").alias("_theirs"))
    ids = lambda c: F.transform(c, lambda x: x["id"])
    held = F.filter("_theirs", lambda x: F.array_contains(ids("steps"), x["id"]))
    new = F.filter("_theirs", lambda x: ~F.array_contains(ids("steps"), x["id"]))
    fits = F.coalesce((ids(held) == ids("steps")) & F.forall(new, lambda x: x["seen"]), F.lit(False))
    return existing.join(theirs, key, "left").select(*key, fits.alias("accepted"), F.when(fits, F.col("_theirs")).otherwise(F.col("steps")).alias("steps"))


def binding_key(service: Column, environment: Column, variable: Column) -> Column:
    """The identity of a configuration binding."""
    return F.concat_ws("|", service, environment, variable)


def configured_addresses(channels: DataFrame, bindings: DataFrame) -> DataFrame:
    """Channels (``service``, ``variable``, ``address``) with the addresses that their variable has by environment.

    ``bindings``: service, environment, variable, value; those without a value say nothing. The address is replaced only if all environments have the same. Adds ``addresses`` (environment: address, in order).
    """
    said = bindings.where("value is not null and value <> ''").groupBy("service", "variable").agg(
        F.array_sort(F.collect_set(F.concat_ws(": ", "environment", "value"))).alias("addresses"), F.count_distinct("value").alias("_n"), F.min("value").alias("_one")
    )
    out = channels.join(said, ["service", "variable"], "left")
    return out.withColumn("address", F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.col("address"))).withColumn("addresses", F.coalesce("addresses", F.array().cast("array<string>"))).drop("_n", "_one")


def describe_commits(stamps: DataFrame, key: list[str], commit: str) -> DataFrame:
    """The one commit that the sources of each key come from, or how many there are; empty without any."""
    n = stamps.groupBy(*key).agg(F.count_distinct(F.nullif(F.col(commit), F.lit(""))).alias("_n"), F.min(F.nullif(F.col(commit), F.lit(""))).alias("_one"))
    return n.select(*key, F.when(F.col("_n") == 0, "").when(F.col("_n") == 1, F.col("_one")).otherwise(F.concat(F.col("_n").cast("string"), F.lit(" sources"))).alias("commits"))


def annotate(annotations: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Annotations with ``unresolved``: no target has their key."""
    known = targets.select(*key).distinct().withColumn("_known", F.lit(True))
    return annotations.join(known, key, "left").withColumn("unresolved", F.col("_known").isNull()).drop("_known")


def in_profile(rows: DataFrame, profiles: str, profile: str) -> DataFrame:
    """Rows for a profile: those that name it, and those that name none."""
    return rows.where((F.coalesce(F.size(profiles), F.lit(0)) == 0) | F.array_contains(profiles, profile))


def within_profile(parts: DataFrame, kept: DataFrame, key: str, ident: str = "id") -> DataFrame:
    """Parts of entities that the profile keeps."""
    return parts.join(kept.select(F.col(ident).alias(key)).distinct(), key, "left_semi")


def host_of(said: Column) -> Column:
    """The host in an address: behind a scheme any name, without user and port; without one only lower-case names, as others are expressions that were not evaluated."""
    said = F.trim(said)
    behind = F.lower(F.regexp_extract(said, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1))
    plain = F.regexp_extract(said, r"^([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)(?::[0-9]+)?$", 1)
    return F.nullif(F.when(said.contains("://"), behind).otherwise(plain), F.lit(""))


def call_host(alias: Column, base_url: Column, ident: Column) -> Column:
    """The host that a call goes to: of its discovery alias, else of its base address, else behind the ``@`` of an HTTP call's id; null where none of them is one (see ``host_of``)."""
    return F.coalesce(host_of(alias), host_of(base_url), host_of(F.regexp_extract(ident, r"^http-client/[A-Z]+\s+/\S*\s@\s(.+)$", 1)))


def answers_on(service: Column, declared: Column, host: Column) -> Column:
    """May a provider answer on a host: it declares the host, a wildcard of it (unless the host is a wildcard itself), or its own name is the host's first label."""
    host = F.lower(host)
    own = F.lower(F.element_at(F.split(service, r"\."), -1))
    named = F.exists(F.coalesce(declared, F.array().cast("array<string>")), lambda h: (F.lower(h) == host) | (h.startswith("*.") & ~host.startswith("*.") & host.endswith(F.lower(F.substring(h, 2, 1 << 20)))))
    return named | F.coalesce(F.split(host, r"\.")[0] == own, F.lit(False))


def name_served(steps: DataFrame, methods: DataFrame) -> DataFrame:
    """Opening steps (``service``, ``ref``, ``label``, ``verb``, ``path``) without a ref, named by the one method of their service that has their label, else their route.

    ``methods``: service, id, name, verb, path. Where none or several fit, the ref stays null.
    """
    only = lambda df, *by: df.groupBy("service", *by).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_id")).where("_n = 1").drop("_n")
    by_name = only(methods, "name").withColumnsRenamed({"name": "label", "_id": "_by_name"})
    by_route = only(methods.where("path is not null").withColumn("_shape", route_shape(F.col("path"))), "verb", "_shape").withColumnsRenamed({"_id": "_by_route"})
    out = steps.withColumn("_shape", route_shape(F.col("path"))).join(by_name, ["service", "label"], "left").join(by_route, ["service", "verb", "_shape"], "left")
    return out.withColumn("ref", F.coalesce("ref", "_by_name", "_by_route")).select(*steps.columns)


def resolve_accesses(steps: DataFrame, accesses: DataFrame, ident: str | None = None) -> DataFrame:
    """Store steps (``store``, ``method``) with the ``operation`` and ``keyspace`` of the one access of the store whose method ends alike; null where none or several do.

    ``accesses``: store, method, operation, keyspace; each row is an access. With ``ident``, what else tells accesses apart, rows that are alike in all five are one: they are
    summed up by their least and greatest, so that nothing has to make them distinct. The end of a method's name is what stands behind its last dot or slash.
    """
    tail = lambda c: F.element_at(F.split(c, r"[./]"), -1)
    number = F.count("*")
    if ident is not None:
        same = (F.count(ident) == 0) | ((F.count(ident) == F.count("*")) & (F.min(ident) == F.max(ident)))
        number = F.when(same, 1).otherwise(2)  # one or several
    alike = accesses.groupBy("store", "method", "operation", "keyspace").agg(number.alias("_n"))
    one = alike.withColumn("_tail", tail(F.col("method"))).groupBy("store", "_tail").agg(F.sum("_n").alias("_n"), F.min("operation").alias("operation"), F.min("keyspace").alias("keyspace")).where("_n = 1").drop("_n")
    return steps.withColumn("_tail", tail(F.col("method"))).join(one, ["store", "_tail"], "left").drop("_tail")


def link_lanes(lanes: DataFrame, accessed: DataFrame, stores: DataFrame, neighbours: DataFrame) -> DataFrame:
    """The store behind each store lane (``flow``, ``lane``): the only one its steps access, else the one of its id, else the only one its neighbours own.

    ``accessed``: flow, lane, store; ``stores``: store, owner; ``neighbours``: flow, lane, service. Adds ``store`` and ``basis``.
    Several stores are one if the least and the greatest are; so an owner's stores are summed up before they meet its neighbours.
    """
    least, most = F.min("_least").alias("_least"), F.max("_most").alias("_most")
    only = lambda df, name: df.groupBy("flow", "lane").agg(least, most).where("_least = _most").select("flow", "lane", F.col("_least").alias(name))
    owned = stores.groupBy("owner").agg(F.min("store").alias("_least"), F.max("store").alias("_most"))
    owned = neighbours.join(owned, F.col("service") == F.col("owner"))
    accessed = accessed.withColumns({"_least": F.col("store"), "_most": F.col("store")})
    named = stores.select(F.col("store").alias("lane"), F.col("store").alias("_named")).distinct()
    out = lanes.join(only(accessed, "_accessed"), ["flow", "lane"], "left").join(named, "lane", "left").join(only(owned, "_owned"), ["flow", "lane"], "left")
    basis = F.when(F.col("_accessed").isNotNull(), "access").when(F.col("_named").isNotNull(), "id").when(F.col("_owned").isNotNull(), "neighbour").otherwise("unresolved")
    return out.select(*lanes.columns, F.coalesce("_accessed", "_named", "_owned").alias("store"), basis.alias("basis"))


def handoff_key(kind: Column, transport: Column, channel: Column, message: Column) -> Column:
    """What a sent and a received message must share to be the same."""
    return F.concat_ws("\0", kind, transport, channel, F.coalesce(message, F.lit("")))


def handoffs(sends: DataFrame, receives: DataFrame) -> DataFrame:
    """Sends with the one flow that opens with what they send; if none opens with that message, the one that opens with the channel and names no message.

    Both: flow, kind, transport, channel, message (null: not said). Adds ``continues`` (null where none or several flows open so) and ``basis``.
    """
    key = handoff_key(*(F.col(c) for c in ("kind", "transport", "channel", "message")))
    wide = handoff_key(F.col("kind"), F.col("transport"), F.col("channel"), F.lit(None))
    opened = receives.groupBy(key.alias("_k")).agg(F.count_distinct("flow").alias("_n"), F.min("flow").alias("_flow"))
    named = lambda at: opened.select(F.col("_k").alias(f"_k{at}"), F.lit(True).alias(f"_is{at}"), F.when(F.col("_n") == 1, F.col("_flow")).alias(at))
    out = sends.withColumn("_k_exact", key).withColumn("_k_topic", wide).join(named("_exact"), "_k_exact", "left").join(named("_topic"), "_k_topic", "left")
    found = F.when(F.col("_is_exact"), F.col("_exact")).otherwise(F.col("_topic"))
    return out.select(*sends.columns, found.alias("continues"), F.when(found.isNull(), None).when(F.col("_is_exact"), "message").otherwise("topic").alias("basis"))


def responses(methods: DataFrame) -> DataFrame:
    """What each synchronous method (``id``, ``response``, ``streaming``) answers: id, response; streamed ones and those without a response say nothing."""
    return methods.where("response is not null and response <> '' and coalesce(streaming, '') = ''").groupBy("id").agg(F.min("response").alias("response"))


def step_answers(steps: DataFrame, methods: DataFrame) -> DataFrame:
    """Steps with the ``response`` of the method that they name (``ref``)."""
    return steps.join(responses(methods).withColumnRenamed("id", "ref"), "ref", "left")


def provider_of(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Calls (``verb``, ``path``) with the first route (``verb``, ``path``, ``provider``, ``method``) that fits: segment by segment, a parameter standing for any one.

    Routes are looked up by their verb, length and first fixed segments, so no call meets all routes. Of several that fit, the least provider and method is taken, so the answer is the same every time.
    """
    split = lambda c: F.filter(F.split(F.regexp_replace(c, "[?#].*$", ""), "/"), lambda x: x != "")
    is_param = lambda x: x.rlike(r"^(\{.*\}|:.+|\*)$")
    head = F.element_at(F.col("_t"), 1)
    r = routes.select(F.upper("verb").alias("_verb"), split(F.col("path")).alias("_t"), "provider", "method").withColumn("_n", F.size("_t"))
    r = r.withColumn("_head", F.when((F.col("_n") == 0) | is_param(head), "").otherwise(head))
    c = calls.withColumn("_verb", F.upper("verb")).withColumn("_p", split(F.col("path"))).withColumn("_n", F.size("_p"))
    asked = c.select("*", F.explode(F.array_distinct(F.array(F.lit(""), F.coalesce(F.try_element_at("_p", F.lit(1)), F.lit(""))))).alias("_head"))
    fits = F.forall(F.zip_with("_t", "_p", lambda t, p: is_param(t) | (t == p)), lambda x: x)
    hits = asked.join(r, ["_verb", "_n", "_head"]).where(fits).groupBy(*calls.columns).agg(F.min(F.struct("provider", "method")).alias("_one"))
    out = calls.join(hits, calls.columns, "left")
    return out.select(*calls.columns, F.col("_one.provider").alias("provider"), F.col("_one.method").alias("method"))


def event_of(messages: DataFrame, events: DataFrame, options: DataFrame) -> DataFrame:
    """Messages (``wire``, ``producer``; null for consumers) as events.

    A given word decides, even if it is no event (then none). Else the one event that declares the wire name; else, by the last segment of the wire name, the one event of the
    producer that ends so; if the producer has none, or the message has no producer, the one event anywhere that ends so. ``events``: id, service, wire; ``options``: wire,
    event. Adds ``event`` and ``basis``; where several events fit, both stay null.
    """
    last = lambda c: F.substring_index(c, ".", -1)
    ended = events.select("id", F.col("service").alias("producer"), last(F.col("id")).alias("_last"))
    only = lambda df, name, *by: df.groupBy(*by).agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_id")).select(*by, F.lit(True).alias(f"{name}_some"), F.when(F.col("_n") == 1, F.col("_id")).alias(name))
    given = options.join(events.select(F.col("id").alias("event"), F.lit(True).alias("_real")).distinct(), "event", "left").select("wire", F.lit(True).alias("_given"), F.when(F.col("_real"), F.col("event")).alias("_option"))
    out = messages.withColumn("_last", last(F.col("wire"))).join(given, "wire", "left").join(only(events, "_declared", "wire"), "wire", "left")
    out = out.join(only(ended, "_own", "producer", "_last"), ["producer", "_last"], "left").join(only(ended, "_any", "_last"), "_last", "left")
    found = F.when(F.col("_own_some"), F.col("_own")).otherwise(F.col("_any"))
    event = F.when(F.col("_given"), F.col("_option")).otherwise(F.coalesce("_declared", found))
    basis = F.when(F.col("_given"), "option").when(F.col("_declared").isNotNull(), "wire").when(F.col("_own_some"), "own").otherwise("anywhere")
    return out.select(*messages.columns, event.alias("event"), F.when(event.isNotNull(), basis).alias("basis"))


def with_undeclared(declared: DataFrame, seen: DataFrame) -> DataFrame:
    """Declared steps of each flow (``flow``, ``ord``, ``key``) with the hops that were only seen (``flow``, ``anchor``, ``key``, ``first``) put behind their anchor step (null: in front): flow, ord, key, declared."""
    place = declared.select("flow", F.col("ord").alias("_a"), F.lit(-1).cast("long").alias("_b"), "key", F.lit(True).alias("declared"))
    at = seen.join(declared.select("flow", F.col("key").alias("anchor"), F.col("ord").alias("_at")), ["flow", "anchor"], "left")
    more = at.select("flow", F.coalesce("_at", F.lit(0)).alias("_a"), F.col("first").cast("long").alias("_b"), "key", F.lit(False).alias("declared"))
    return place.unionByName(more).withColumn("ord", F.row_number().over(Window.partitionBy("flow").orderBy("_a", "_b", "key")).cast("long")).select("flow", "ord", "key", "declared")
