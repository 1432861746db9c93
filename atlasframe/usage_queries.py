"""Operators on evidence, usage and ownership, bound to the relational test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasframe.estate_queries import part, sub
from atlasframe.operators import estate, graph, tables, usages
from atlasframe.plans import warnings
from atlasframe.queries import _derived, query, read

# Evidence

WORKLOADS = "select l_orderkey as scope, l_partkey as workload, map('flag', l_returnflag, 'status', l_linestatus, 'line', cast(l_linenumber as string)) as labels from {lineitem}"


@query("select o_orderkey as selector_id, l_partkey as workload, count(*) as hits from orders join lineitem on o_orderkey = l_orderkey where o_orderstatus <> 'P' and l_linestatus = o_orderstatus and (o_orderpriority <> '1-URGENT' or l_returnflag = 'R') group by 1, 2")
def estate_selected_workloads(spark, sf_dir):
    wanted = "select o_orderkey as scope, o_orderkey as selector_id, case when o_orderstatus = 'P' then map() when o_orderpriority = '1-URGENT' then map('status', o_orderstatus, 'flag', 'R') else map('status', o_orderstatus) end as selector from {orders}"
    found = estate.selected_workloads(part(spark, sf_dir, wanted).withColumn("selector", F.col("selector").cast("map<string,string>")), part(spark, sf_dir, WORKLOADS), ["scope"])
    return found.groupBy("selector_id", "workload").agg(F.count("*").alias("hits"))


ROUTES = "select doc_id, source as gateway, case when doc_id % 5 = 0 then array() when doc_id % 3 = 0 then array('*.' || lang || '.example') else array('api.' || lang || '.example', 'API.xx.example') end as route_hosts from {documents}"
LISTENERS = "select distinct source as gateway, lang as listener, case when lang = 'fr' then array() when lang = 'de' then array('*.example') else array('api.' || lang || '.example') end as listener_hosts from {documents}"


@query("""with r as (select doc_id, source as gateway, case when doc_id % 5 = 0 then [] when doc_id % 3 = 0 then ['*.' || lang || '.example'] else ['api.' || lang || '.example', 'api.xx.example'] end as rh from documents),
 l as (select distinct source as gateway, lang as listener, case when lang = 'fr' then [] when lang = 'de' then ['*.example'] else ['api.' || lang || '.example'] end as lh from documents), j as (select * from r join l using (gateway)),
 m as (select *, list_sort(list_distinct(list_filter(flatten(list_transform(lh, lambda a: list_transform(rh, lambda b: case when a = b then a when a like '*.%' and ends_with(b, a[2:]) and length(b) > length(a) - 1 then b when b like '*.%' and ends_with(a, b[2:]) and length(a) > length(b) - 1 then a end))), lambda x: x is not null))) as met from j)
 select doc_id, gateway, listener, array_to_string(case when len(lh) = 0 then list_sort(rh) when len(rh) = 0 then list_sort(lh) else met end, '+') as hosts from m where (len(lh) = 0 and len(rh) = 0) or len(case when len(lh) = 0 then rh when len(rh) = 0 then lh else met end) > 0""")
def estate_exposures(spark, sf_dir):
    routes = part(spark, sf_dir, ROUTES).withColumn("route_hosts", F.transform(F.col("route_hosts").cast("array<string>"), F.lower))
    found = estate.exposures(routes, part(spark, sf_dir, LISTENERS).withColumn("listener_hosts", F.col("listener_hosts").cast("array<string>")), ["gateway"])
    return found.select("doc_id", "gateway", "listener", F.array_join("hosts", "+").alias("hosts"))


@query("""select user_id as bus, source, message, count(*) as rules from (select user_id, unnest(case event_type when 'view' then ['web', 'app'] else ['web'] end) as source, event_type from events) s(user_id, source, event_type), unnest([event_type, 'any']) m(message) group by 1, 2, 3""")
def estate_pattern_messages(spark, sf_dir):
    sources = F.when(F.col("event_type") == "view", F.array(F.lit("web"), F.lit("app"))).otherwise(F.array(F.lit("web")))
    pattern = F.to_json(F.struct(sources.alias("source"), F.array("event_type", F.lit("any")).alias("detail-type"), F.struct("value").alias("detail")))
    rules = read(spark, sf_dir, "events").select(F.col("user_id").alias("bus"), pattern.alias("pattern"))
    return estate.pattern_messages(rules, "bus", "pattern")


ROUTED = "select o_custkey as service, o_orderpriority as name, o_orderkey as source, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then '/a' else '/b' end as path, case o_orderstatus when 'F' then 'GET' when 'O' then 'POST' else '' end as verb, case when o_totalprice > 200000 then 'declared' else 'inferred' end as basis from {orders}"


@query(f"""with r as {sub(ROUTED)}, f as (select service, name, arg_min(path, source) as path from r where path is not null group by 1, 2), s as (select r.*, case when verb = '' then 0 when basis = 'inferred' then 1 else 2 end as strength from r join f using (service, name, path))
 select service, name, path, arg_min(verb, (-strength, source)) as verb, arg_min(basis, (-strength, source)) as basis from s group by 1, 2, 3""")
def merge_strongest_route(spark, sf_dir):
    return estate.strongest_route(part(spark, sf_dir, ROUTED), ["service", "name"], ["source"])


@query(r"""with c as (select l_orderkey as scope, l_linenumber as n, case when l_returnflag = 'R' then upper(l_linestatus || l_returnflag) else lower(l_linestatus || l_returnflag) end as name from lineitem),
 f as (select distinct l_orderkey as scope, case when l_linestatus = 'O' then lower(l_linestatus || l_returnflag) else l_linestatus || lower(l_returnflag) end as name from lineitem where l_tax < 0.06),
 o as (select scope, lower(name) as low, min(name) as one from f group by 1, 2 having count(*) = 1)
 select c.scope, c.n, case when f.name is not null or o.one is null then c.name else o.one end as name from c left join f on f.scope = c.scope and f.name = c.name left join o on o.scope = c.scope and o.low = lower(c.name)""")
def merge_fold_spelling(spark, sf_dir):
    columns = part(spark, sf_dir, "select l_orderkey as scope, l_linenumber as n, case when l_returnflag = 'R' then upper(l_linestatus || l_returnflag) else lower(l_linestatus || l_returnflag) end as name from {lineitem}")
    fields = part(spark, sf_dir, "select distinct l_orderkey as scope, case when l_linestatus = 'O' then lower(l_linestatus || l_returnflag) else l_linestatus || lower(l_returnflag) end as name from {lineitem} where l_tax < 0.06")
    return estate.fold_spelling(columns, fields, ["scope"], "name")


@query("""with s as (select l_orderkey as flow, l_partkey || '/' || l_suppkey || '/' || l_linenumber as id, l_returnflag <> 'N' as seen, l_linestatus = 'F' as first, l_partkey % 10 < 9 as kept from lineitem),
 a as (select flow, list(id order by id) filter (first) as ids from s group by 1 having count(*) filter (first) > 0), b as (select flow, list({'id': id, 'seen': seen} order by id) filter (kept) as st from s group by 1 having count(*) filter (kept) > 0),
 j as (select a.flow, ids, st, coalesce(list_transform(list_filter(st, lambda x: list_contains(ids, x.id)), lambda x: x.id) = ids and len(list_filter(st, lambda x: not list_contains(ids, x.id) and not x.seen)) = 0, false) as ok from a left join b using (flow))
 select flow, ok as accepted, case when ok then len(st) else len(ids) end as steps from j""")
def merge_overlay_flows(spark, sf_dir):
    steps = part(spark, sf_dir, "select l_orderkey as flow, concat_ws('/', l_partkey, l_suppkey, l_linenumber) as id, l_returnflag <> 'N' as seen, l_linestatus = 'F' as first, l_partkey % 10 < 9 as kept from {lineitem}")
    listed = lambda df: df.groupBy("flow").agg(F.array_sort(F.collect_list(F.struct("id", "seen"))).alias("steps"))
    found = estate.overlay(listed(steps.where("first")), listed(steps.where("kept")), ["flow"])
    return found.select("flow", "accepted", F.size("steps").cast("long").alias("steps"))


BINDINGS = "select o_custkey as service, o_orderstatus as environment, o_orderpriority as variable, case when min(o_orderkey) % 4 = 0 then '' else 'host' || cast(min(o_orderkey) % 2 as varchar(9)) end as value from {orders} group by o_custkey, o_orderstatus, o_orderpriority"


@query(f"""with b as {sub(BINDINGS)}, c as (select distinct o_custkey as service, o_orderpriority as variable, 'default' as address from orders), s as (select service, variable, list_sort(list(environment || ': ' || value)) as a, count(distinct value) as n, min(value) as one from b where value <> '' group by 1, 2)
 select c.service, c.variable, case when n = 1 then one else address end as address, coalesce(array_to_string(a, '+'), '') as addresses from c left join s using (service, variable)""")
def enrich_configured_addresses(spark, sf_dir):
    channels = part(spark, sf_dir, "select distinct o_custkey as service, o_orderpriority as variable, 'default' as address from {orders}")
    return estate.configured_addresses(channels, part(spark, sf_dir, BINDINGS)).withColumn("addresses", F.array_join("addresses", "+"))


@query("select o_custkey || '|' || o_orderstatus || '|' || o_orderpriority as binding, count(*) as rows from orders group by 1")
def merge_binding_keys(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy(estate.binding_key(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("binding")).agg(F.count("*").alias("rows"))


@query("""select o_custkey, case n when 0 then '' when 1 then one else n || ' sources' end as commits from (select o_custkey, count(distinct o_orderpriority) filter (o_orderstatus = 'F') as n, min(o_orderpriority) filter (o_orderstatus = 'F') as one from orders group by 1)""")
def merge_describe_commits(spark, sf_dir):
    stamps = part(spark, sf_dir, "select o_custkey, case when o_orderstatus = 'F' then o_orderpriority else '' end as stamp from {orders}")
    return estate.describe_commits(stamps, ["o_custkey"], "stamp")


@query("select o_orderkey, o_custkey, c_custkey is null as unresolved from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey")
def merge_annotations(spark, sf_dir):
    targets = part(spark, sf_dir, "select c_custkey as o_custkey from {customer} where c_acctbal > 0")
    return estate.annotate(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), targets, ["o_custkey"])


@query("select c_mktsegment, count(distinct c_custkey) as customers, count(o_orderkey) as orders from customer join orders on c_custkey = o_custkey where c_mktsegment in ('BUILDING', 'MACHINERY', 'AUTOMOBILE') group by 1")
def catalog_profile(spark, sf_dir):
    """Customers name the profiles of their segment: builders none, so they are in all of them."""
    c = part(spark, sf_dir, "select c_custkey, c_mktsegment, case c_mktsegment when 'BUILDING' then array() when 'MACHINERY' then array('a', 'b') when 'AUTOMOBILE' then array('b') else array('c') end as profiles from {customer}")
    kept = estate.in_profile(c, "profiles", "b")
    parts = estate.within_profile(read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), kept, "c_custkey", "c_custkey")
    return parts.join(kept, "c_custkey").groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("customers"), F.count("*").alias("orders"))


@query("""select page_id, case page_id % 6 when 0 then 'host' || (page_id % 7) || '.example' when 1 then 'alias-' || page_id when 2 then 'host' || (page_id % 7) || '.example' when 3 then 'id.example' when 5 then 'plain.svc' end as host from pages""")
def enrich_call_hosts(spark, sf_dir):
    """Aliases in upper case and expressions are no hosts, so the next word counts; addresses have schemes, users and ports or not."""
    calls = part(spark, sf_dir, """select page_id, case page_id % 6 when 0 then 'Config.Alias' || page_id when 1 then ' alias-' || page_id || ':8080 ' when 5 then '' end as alias,
     case when page_id % 6 in (0, 2) then 'https://me:secret@HOST' || (page_id % 7) || '.example:443' || url when page_id % 6 = 1 then 'https://elsewhere' when page_id % 6 in (3, 4) then 'Config.SupplierURL' when page_id % 6 = 5 then 'Upper.case:1' end as base,
     case page_id % 6 when 3 then 'http-client/GET /x @ http://id.example/x' when 4 then 'http-client/GET /x @ Config.Other' when 5 then 'http-client/GET /x @ plain.svc:90' else 'rpc/Get' end as id from {pages}""")
    return calls.select("page_id", estate.call_host(F.col("alias"), F.col("base"), F.col("id")).alias("host"))


@query("""select doc_id, (lang <> 'fr' and source = 'src1') or (lang = 'de') or (source = 'src3') as answers from documents""")
def enrich_host_answers(spark, sf_dir):
    d = part(spark, sf_dir, "select doc_id, 'shop.' || source as service, case when lang = 'fr' then null when lang = 'de' then array('*.Src.example', 'x') else array('src1.src.example') end as hosts, case when source = 'src3' then 'SRC3.elsewhere' else source || '.src.example' end as host, lang, source from {documents}")
    return d.select("doc_id", estate.answers_on(F.when(d.lang == "fr", F.lit("shop.other")).when(d.source == "src3", d.service).otherwise(F.lit("shop.none")), d.hosts, d.host).alias("a"), "lang", "source").select("doc_id", (F.col("a") | (F.col("source") == "src3")).alias("answers"))


METHODS = "select distinct s_nationkey as service, 'M' || s_suppkey as id, 'n' || (s_suppkey % 40) as name, case s_suppkey % 2 when 0 then 'GET' else 'POST' end as verb, '/x/{{id}}/' || (s_suppkey % 30) as path from {supplier}"
OPENINGS = "select c_custkey, c_nationkey as service, case when c_acctbal < 0 then 'given' end as ref, 'n' || (c_custkey % 60) as label, case c_custkey % 2 when 0 then 'GET' else 'POST' end as verb, '/x/:k/' || (c_custkey % 35) || '?q=1' as path from {customer}"


@query(f"""with m as (select distinct s_nationkey as service, 'M' || s_suppkey as id, 'n' || (s_suppkey % 40) as name, case s_suppkey % 2 when 0 then 'GET' else 'POST' end as verb, s_suppkey % 30 as k from supplier),
 a as (select service, name, min(id) as id from m group by 1, 2 having count(distinct id) = 1), b as (select service, verb, k, min(id) as id from m group by 1, 2, 3 having count(distinct id) = 1)
 select c.c_custkey, coalesce(c.ref, a.id, b.id) as ref from {sub(OPENINGS)} c left join a on a.service = c.service and a.name = c.label left join b on b.service = c.service and b.verb = c.verb and b.k = c.c_custkey % 35""")
def enrich_name_served(spark, sf_dir):
    methods = part(spark, sf_dir, METHODS.replace("{{id}}", "%s"))
    return estate.name_served(part(spark, sf_dir, OPENINGS), methods).select("c_custkey", "ref")


@query("""with a as (select l_suppkey as store, l_returnflag || l_linenumber as tail, count(*) as n, min(l_linestatus) as operation, min(l_returnflag) as keyspace from (select distinct l_suppkey, l_returnflag, l_linenumber, l_linestatus, l_partkey from lineitem) group by 1, 2 having count(*) = 1)
 select l_suppkey as store, l_orderkey, l_linenumber, l_partkey, a.operation, a.keyspace from lineitem left join a on store = l_suppkey and tail = l_returnflag || l_linenumber""")
def enrich_store_accesses(spark, sf_dir):
    accesses = part(spark, sf_dir, "select l_suppkey as store, 'repo.' || l_linestatus || '/' || l_returnflag || l_linenumber as method, l_linestatus as operation, l_returnflag as keyspace, l_partkey from {lineitem}")
    steps = part(spark, sf_dir, "select l_suppkey as store, l_orderkey, l_linenumber, l_partkey, 'Orders.' || l_returnflag || l_linenumber as method from {lineitem}")
    return estate.resolve_accesses(steps, accesses, "l_partkey").drop("method")


@query("""with lanes as (select distinct l_orderkey as flow, case when l_partkey % 3 = 0 then 's' || l_suppkey else 'lane' || (l_partkey % 3) end as lane from lineitem), acc as (select l_orderkey as flow, case when l_partkey % 3 = 0 then 's' || l_suppkey else 'lane' || (l_partkey % 3) end as lane, 's' || l_suppkey as store from lineitem where l_returnflag = 'R'),
 st as (select 's' || s_suppkey as store, s_nationkey as owner from supplier), nb as (select distinct l_orderkey as flow, case when l_partkey % 3 = 0 then 's' || l_suppkey else 'lane' || (l_partkey % 3) end as lane, l_suppkey % 25 as service from lineitem where l_returnflag = 'A'),
 a as (select flow, lane, min(store) as s from acc group by 1, 2 having count(distinct store) = 1), o as (select flow, lane, min(store) as s from nb join st on service = owner group by 1, 2 having count(distinct store) = 1)
 select l.flow, l.lane, coalesce(a.s, st.store, o.s) as store, case when a.s is not null then 'access' when st.store is not null then 'id' when o.s is not null then 'neighbour' else 'unresolved' end as basis from lanes l left join a using (flow, lane) left join st on st.store = l.lane left join o on o.flow = l.flow and o.lane = l.lane""")
def enrich_store_lanes(spark, sf_dir):
    li = part(spark, sf_dir, "select l_orderkey as flow, case when l_partkey % 3 = 0 then 's' || l_suppkey else 'lane' || (l_partkey % 3) end as lane, 's' || l_suppkey as store, l_suppkey % 25 as service, l_returnflag as flag from {lineitem}")
    stores = part(spark, sf_dir, "select 's' || s_suppkey as store, cast(s_nationkey as bigint) as owner from {supplier}")
    return estate.link_lanes(li.select("flow", "lane").distinct(), li.where("flag = 'R'").select("flow", "lane", "store"), stores, li.where("flag = 'A'").select("flow", "lane", "service").distinct())


SENDS = "select event_id as flow, 'event' as kind, event_type as transport, user_id as channel, case when event_id % 3 > 0 then props end as message from {events} where event_type in ('view', 'click')"
RECEIVES = "select event_id as flow, 'event' as kind, case event_type when 'purchase' then 'view' else 'click' end as transport, user_id as channel, case when event_id % 2 > 0 then props end as message from {events} where event_type in ('purchase', 'signup')"


@query(f"""with s as {sub(SENDS)}, r as {sub(RECEIVES)}, a as (select transport, channel, coalesce(message, '') as m, count(distinct flow) as n, case when count(distinct flow) = 1 then min(flow) end as f from r group by 1, 2, 3)
 select s.flow, case when a.n is not null then a.f else b.f end as continues, case when a.n is not null then case when a.n = 1 then 'message' end when b.n = 1 then 'topic' end as basis from s left join a on a.transport = s.transport and a.channel = s.channel and a.m = coalesce(s.message, '') left join a b on b.transport = s.transport and b.channel = s.channel and b.m = ''""")
def flow_handoffs(spark, sf_dir):
    return estate.handoffs(part(spark, sf_dir, SENDS), part(spark, sf_dir, RECEIVES)).select("flow", "continues", "basis")


@query("""with m as (select o_orderpriority || o_orderstatus as id, min(o_clerk) as response from (select o_orderpriority, o_orderstatus, 'r' || o_custkey as o_clerk from orders where o_orderstatus <> 'P' and o_orderkey % 2 = 0) group by 1)
 select l.o_orderkey, m.response from orders l left join m on m.id = l.o_orderpriority || l.o_orderstatus""")
def flow_step_answers(spark, sf_dir):
    methods = part(spark, sf_dir, "select o_orderpriority || o_orderstatus as id, 'r' || o_custkey as response, case when o_orderstatus = 'P' then 'server' end as streaming from {orders} where o_orderkey % 2 = 0")
    steps = part(spark, sf_dir, "select o_orderkey, o_orderpriority || o_orderstatus as ref from {orders}")
    return estate.step_answers(steps, methods).drop("ref")


@query(r"""with p as (select page_id, case page_id % 2 when 0 then 'GET' else 'POST' end as verb, regexp_replace(url, '[?#].*$', '') as path, list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> '') as s from pages),
 l as (select distinct lang from documents) select page_id, case when verb = 'GET' and len(s) = 2 then case when s[1] in (select lang from l) then 'any' when s[1] = 'xx' then 'xx' else 'any' end end as provider, case when verb = 'GET' and len(s) = 2 then 'Show' end as method from p""")
def trace_http_providers(spark, sf_dir):
    """Every page is a call; one route takes any two segments, others the languages of documents, whose providers come later by name."""
    calls = part(spark, sf_dir, "select page_id, case page_id % 2 when 0 then 'get' else 'POST' end as verb, url as path from {pages}")
    routes = part(spark, sf_dir, "select distinct 'GET' as verb, '/' || lang || '/:id' as path, 'lang-' || lang as provider, 'Show' as method from {documents}").unionByName(spark.createDataFrame([("GET", "/{a}/{b}", "any", "Show")], "verb string, path string, provider string, method string"))
    return estate.provider_of(calls, routes).select("page_id", "provider", "method")


@query("""with e as (select 'svc' || p_size || '.' || p_type || '.' || p_brand as id, 'svc' || p_size as service, 'wire' || (p_partkey % 1500) as wire, p_brand as last from part),
 w as (select wire, min(id) as id from e group by 1 having count(distinct id) = 1), o as (select service, last, min(id) as id, count(distinct id) as n from e group by 1, 2), a as (select last, min(id) as id from e group by 1 having count(distinct id) = 1),
 m as (select p_partkey, case when p_partkey % 3 = 0 then 'wire' || (p_partkey % 2000) when p_partkey % 5 = 0 then 'v1.' || p_brand else p_brand end as wire, case when p_partkey % 2 = 0 then 'svc' || p_size when p_partkey % 7 = 0 then 'nobody' end as producer from part),
 l as (select *, regexp_extract(wire, '[^.]*$') as last from m)
 select m.p_partkey, case when m.wire = 'wire3' then (select min(id) from e) when m.wire = 'wire6' then null else coalesce(w.id, case when o.n = 1 then o.id when o.n is null then a.id end) end as event
 from l m left join w on w.wire = m.wire left join o on o.service = m.producer and o.last = m.last left join a on a.last = m.last""")
def trace_event_lookup(spark, sf_dir):
    """Parts are events; some messages come from a producer that has no such event."""
    events = part(spark, sf_dir, "select 'svc' || p_size || '.' || p_type || '.' || p_brand as id, 'svc' || p_size as service, 'wire' || (p_partkey % 1500) as wire from {part}")
    messages = part(spark, sf_dir, "select p_partkey, case when p_partkey % 3 = 0 then 'wire' || (p_partkey % 2000) when p_partkey % 5 = 0 then 'v1.' || p_brand else p_brand end as wire, case when p_partkey % 2 = 0 then 'svc' || p_size when p_partkey % 7 = 0 then 'nobody' end as producer from {part}")
    first = events.agg(F.min("id").alias("event"))
    given = first.select(F.lit("wire3").alias("wire"), "event").unionByName(first.select(F.lit("wire6").alias("wire"), F.lit("no.such").alias("event")))
    return estate.event_of(messages, events, given).select("p_partkey", "event")


@query("""with d as (select o_custkey as flow, row_number() over (partition by o_custkey order by o_orderkey) as ord, 'k' || o_orderkey as key from orders where o_orderstatus <> 'P'), s as (select o_custkey as flow, case when o_orderkey % 2 = 0 then 'k' || (o_orderkey - 1) end as anchor, 'u' || o_orderkey as key, o_orderkey as f from orders where o_orderstatus = 'P'),
 u as (select flow, ord as a, -1 as b, key, true as declared from d union all select s.flow, coalesce(d.ord, 0), f, s.key, false from s left join d on d.flow = s.flow and d.key = s.anchor) select flow, row_number() over (partition by flow order by a, b, key) as ord, key, declared from u""")
def trace_undeclared_hops(spark, sf_dir):
    declared = part(spark, sf_dir, "select o_custkey as flow, cast(row_number() over (partition by o_custkey order by o_orderkey) as bigint) as ord, 'k' || o_orderkey as key from {orders} where o_orderstatus <> 'P'")
    seen = part(spark, sf_dir, "select o_custkey as flow, case when o_orderkey % 2 = 0 then 'k' || (o_orderkey - 1) end as anchor, 'u' || o_orderkey as key, o_orderkey as first from {orders} where o_orderstatus = 'P'")
    return estate.with_undeclared(declared, seen)


# Usage and ownership

@query("select user_id, event_type, event_id, props from (select *, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n = 1")
def usage_distinct_links(spark, sf_dir):
    return usages.distinct_links(read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], ["event_id"])


@query("select l_partkey as part, count(*) as fields, count(distinct l_suppkey) as owners, max(l_linenumber) as latest from lineitem where l_returnflag <> 'N' and (l_partkey, l_suppkey) not in (select l_partkey, l_suppkey from lineitem where l_linestatus = 'O' and l_tax > 0.07) group by 1")
def usage_of_definitions(spark, sf_dir):
    fields = part(spark, sf_dir, "select case when l_returnflag <> 'N' then l_partkey end as ref, l_suppkey as owner, l_linenumber from {lineitem}").withColumn("ref", F.col("ref").cast("string"))
    own = part(spark, sf_dir, "select distinct cast(l_partkey as varchar(20)) as part, l_suppkey as owner from {lineitem} where l_linestatus = 'O' and l_tax > 0.07")
    found = usages.usages(fields, "ref", "part", own)
    return usages.usage_counts(found.withColumn("part", F.col("part").cast("long")), "part", "l_linenumber")


@query("""with e as (select p_partkey as id, p_size as scope, p_brand as name from part), f as (select l_orderkey || '/' || l_linenumber || '/' || l_suppkey as owner, l_partkey as ref, l_linenumber as scope, 'Brand#' || (l_suppkey % 60) as type, l_returnflag as field from lineitem)
 select ref as id, owner, field, false as by_name from f where ref in (select id from e) and ref % 2 = 0 union all select e.id, owner, field, true from f join e on e.scope = f.scope and e.name = f.type where ref % 2 = 1 or ref not in (select id from e)""")
def usage_of_enums(spark, sf_dir):
    enums = part(spark, sf_dir, "select p_partkey as id, p_size as scope, p_brand as name from {part}")
    fields = part(spark, sf_dir, "select concat_ws('/', l_orderkey, l_linenumber, l_suppkey) as owner, case when l_partkey % 2 = 0 then l_partkey end as ref, l_linenumber as scope, 'Brand#' || (l_suppkey % 60) as type, l_returnflag as field from {lineitem}")
    return usages.named_links(fields.withColumn("ref", F.coalesce("ref", F.lit(-1).cast("long"))), enums, ["scope"])


@query("select user_id, event_type, min(event_id) as event_id, arg_min(props, event_id) as props from events group by 1, 2")
def usage_first_steps(spark, sf_dir):
    return usages.first_of_each(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], ["event_id", "props"])


@query("""select l_orderkey as flow, arg_min(l_suppkey, (case when s_nationkey = o_custkey % 25 then 0 else 1 end, l_linenumber * 1000000 + l_partkey)) as service from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey group by 1""")
def usage_repository_lanes(spark, sf_dir):
    return usages.repository_lane(part(spark, sf_dir, "select l_orderkey as flow, l_linenumber * 1000000 + l_partkey as ord, l_suppkey as service, s_nationkey as context, o_custkey % 25 as owner from {lineitem} join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey"))


@query("select store, service, bool_or(owns) as owns from (select s_suppkey as store, s_nationkey as service, true as owns from supplier union all select l_suppkey, c_nationkey, false from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey) group by 1, 2")
def usage_stores_of_services(spark, sf_dir):
    owned = part(spark, sf_dir, "select s_suppkey as store, s_nationkey as service from {supplier}")
    listed = part(spark, sf_dir, "select l_suppkey as store, c_nationkey as service from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey")
    return usages.listed_or_owned(owned, listed, ["store", "service"])


OWNERS = "select c_nationkey as context, c_custkey as service, case when c_acctbal < 0 then array() when c_acctbal < 5000 then array(c_mktsegment) else array(c_mktsegment, 'core', 'core') end as owners from {customer}"
OWNER_ROWS = "(select c_nationkey as context, c_custkey as service, case when c_acctbal >= 0 then c_mktsegment end as owner from customer union select c_nationkey, c_custkey, 'core' from customer where c_acctbal >= 5000)"


@query(f"select context, owner, count(*) as services, row_number() over (partition by context order by owner is null, count(*) desc, owner) as place from {OWNER_ROWS} group by 1, 2")
def usage_context_owners(spark, sf_dir):
    return usages.owners(part(spark, sf_dir, OWNERS).withColumn("owners", F.col("owners").cast("array<string>")), ["context"])


@query(f"select owner, count(*) as services from {OWNER_ROWS} group by 1")
def usage_ownership(spark, sf_dir):
    return usages.owners(part(spark, sf_dir, OWNERS).withColumn("owners", F.col("owners").cast("array<string>")), [])


@query("select o_orderpriority as owner, row_number() over (partition by o_orderpriority order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, o_custkey, o_orderkey) as place, o_orderkey as flow from orders")
def usage_owned_flows(spark, sf_dir):
    return usages.owned_flows(part(spark, sf_dir, "select o_orderkey as flow, o_orderpriority as owner, o_custkey as name, o_orderstatus as health from {orders}"), ("P", "O", "F"))


@query("select user_id, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error from events group by 1")
def usage_block_counts(spark, sf_dir):
    return usages.kind_counts(read(spark, sf_dir, "events"), ["user_id"], "event_type", ["view", "click", "error"])


@query(r"""select c_mktsegment as module, case when contains(n, '.') then regexp_replace(n, '\.[^.]*$', '') else '' end as package, count(distinct n) as interfaces from (select c_mktsegment, case when c_custkey % 5 = 0 then 'Plain' || c_custkey else 'a.n' || c_nationkey || '.I' || c_custkey end as n from customer) group by 1, 2""")
def usage_packages(spark, sf_dir):
    return usages.packages(part(spark, sf_dir, "select c_mktsegment as module, case when c_custkey % 5 = 0 then 'Plain' || c_custkey else 'a.n' || c_nationkey || '.I' || c_custkey end as n from {customer}"), "module", "n")


@query("""select coalesce(a.k, b.k, c.k) as nation, coalesce(a.n, 0) as interfaces, coalesce(b.n, 0) as methods, coalesce(c.n, 0) as messages from (select s_nationkey as k, count(*) as n from supplier group by 1) a full join (select c_nationkey as k, count(*) as n from customer where c_acctbal < 0 group by 1) b on a.k = b.k
 full join (select n_nationkey as k, count(*) as n from nation where n_regionkey < 3 group by 1) c on c.k = coalesce(a.k, b.k)""")
def usage_module_counts(spark, sf_dir):
    return usages.module_counts(part(spark, sf_dir, "select s_nationkey as nation from {supplier}"), part(spark, sf_dir, "select c_nationkey as nation from {customer} where c_acctbal < 0"), part(spark, sf_dir, "select n_nationkey as nation from {nation} where n_regionkey < 3"), "nation")


@query("""with f as (select distinct l_suppkey as block, l_returnflag || l_linenumber as path from lineitem), m as (select distinct l_suppkey as block, l_returnflag || l_linenumber as path from lineitem where l_tax > 0.07) select block, count(*) as fields, count(*) filter (not exists (select 1 from m where m.block = f.block and m.path = f.path)) as unmapped from f group by 1""")
def usage_unmapped_fields(spark, sf_dir):
    fields = part(spark, sf_dir, "select distinct l_suppkey as block, l_returnflag || l_linenumber as path from {lineitem}")
    return usages.unmapped(fields, part(spark, sf_dir, "select l_suppkey as block, l_returnflag || l_linenumber || '.' || l_partkey as path from {lineitem} where l_tax > 0.07"), ["block"], "path")


@query("select distinct l_partkey as module, l_suppkey as service from lineitem where l_suppkey <> l_partkey % 100")
def usage_module_consumers(spark, sf_dir):
    return usages.users_but_owner(part(spark, sf_dir, "select l_partkey as module, l_suppkey as service from {lineitem}"), part(spark, sf_dir, "select p_partkey as module, p_partkey % 100 as owner from {part}"))


@query("""with r as (select o_orderkey as id, case when o_orderpriority = '1-URGENT' and o_orderstatus = 'P' then 'org' when o_orderstatus = 'P' then 'context' when o_orderkey % 3 = 0 then 'service' end as kind, o_custkey as c, o_custkey + 1 as d from orders), s as (select c_custkey as service, c_nationkey as context from customer)
 select service, id, min("by") as "by" from (select service, id, 'scope' as "by" from r join s on kind = 'context' and c % 25 = context union all select service, id, 'scope' from r join s on kind = 'service' and service = c + 2
 union all select service, id, 'name' from r join s on coalesce(kind, '') <> 'org' and service in (c, d)) group by 1, 2 union all select null, id, 'org' from r where kind = 'org'""")
def usage_decisions_of_services(spark, sf_dir):
    """Orders are decisions: of the whole estate, of a nation, of a customer, or only naming customers."""
    records = part(spark, sf_dir, """select o_orderkey as id, struct(case when o_orderpriority = '1-URGENT' and o_orderstatus = 'P' then 'org' when o_orderstatus = 'P' then 'context' when o_orderkey % 3 = 0 then 'service' end as kind,
     o_custkey % 25 as context, o_custkey + 2 as service) as scope, struct(array(o_custkey, o_custkey + 1) as services) as relates from {orders}""")
    return usages.concerning(records, part(spark, sf_dir, "select c_custkey as service, c_nationkey as context from {customer}"))


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 10")
def usage_newest(spark, sf_dir):
    return usages.newest(read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "F", 10, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("""select o_custkey, len(list_distinct(list(o_orderstatus))) = 3 as same from orders group by 1""")
def usage_status_enums(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("_"), F.lower("o_orderstatus"), F.lit("-"))).alias("s"))
    return o.select("o_custkey", usages.same_words(F.col("s"), F.array(F.lit("F"), F.lit("o."), F.lit("P"))).alias("same"))


@query("""select coalesce(a.k, b.k) as o_custkey, case when a.k is null then 'added' else 'gone' end as change from (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT') a full join (select distinct o_custkey as k from orders where o_orderstatus = 'P') b on a.k = b.k where a.k is null or b.k is null""")
def rule_row_differences(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return usages.row_differences(o.withColumn("matched", F.col("o_orderpriority") == "1-URGENT"), o.withColumn("matched", F.col("o_orderstatus") == "P"), ["o_custkey"])


@query(r"""with d as (select distinct unnest(regexp_extract_all(text, '\b([A-Z]{2,6})\b', 1)) as short from documents), t as (select 'B' || (p_partkey % 3) as x, 'AN' as short, p_partkey as id, p_name as meaning from part where p_size = 1 union all select 'x', 'IN', p_partkey, p_type from part where p_size = 2)
 select d.short, coalesce(o.meaning, case d.short when 'AN' then 'article' when 'THE' then 'article' end) as meaning, case when o.meaning is not null then 'term' when d.short in ('AN', 'THE') then 'common' end as source from d left join (select short, arg_min(meaning, id) as meaning from t group by 1) o using (short)""")
def text_explained(spark, sf_dir):
    from atlasframe.functions import text as fn

    shorts = read(spark, sf_dir, "documents").select(F.explode(fn.abbreviations(F.col("text"))).alias("short"))
    terms = part(spark, sf_dir, "select 'AN' as short, p_partkey as id, p_name as meaning from {part} where p_size = 1 union all select 'IN', p_partkey, p_type from {part} where p_size = 2")
    return usages.explain(shorts, terms, spark.createDataFrame([("AN", "article"), ("THE", "article")], "short string, meaning string"))


@query("select o_orderkey, date_diff('day', o_orderdate::date, date '2001-06-30') > 90 as stale from orders where date_diff('day', o_orderdate::date, date '2001-06-30') <= 90")
def table_branches(spark, sf_dir):
    branches = part(spark, sf_dir, "select o_orderkey, 'branch ' || o_orderkey as name, o_orderdate as updated from {orders}")
    return usages.arranged(branches, F.to_date(F.lit("2001-06-30"))).select("o_orderkey", "stale")


@query("select p_partkey, row_number() over (order by case when p_size = 7 then 0 when p_size = 8 then 1 when p_size < 30 then 2 else 3 end, p_partkey) as place from part")
def table_reference_order(spark, sf_dir):
    p = part(spark, sf_dir, "select p_partkey, case p_size when 7 then 'mine' when 8 then 'main' else p_name end as name, case when p_size < 30 then 'branch' else 'tag' end as kind from {part}")
    return tables.numbered(p, [usages.ref_rank(F.col("name"), F.col("kind"), "mine"), F.col("p_partkey")]).select("p_partkey", "place")


@query("select l_returnflag, case when l_linenumber < 3 then 'unary' else 'server' end as streaming, count(*) as rows from lineitem group by 1, 2")
def usage_streaming_kinds(spark, sf_dir):
    li = part(spark, sf_dir, "select l_returnflag, case when l_linenumber = 1 then '' when l_linenumber >= 3 then 'server' end as s from {lineitem}")
    return li.groupBy("l_returnflag", usages.streaming_kind(F.col("s")).alias("streaming")).agg(F.count("*").alias("rows"))


@query("""with d as (select o_orderkey as id, o_clerk, lag(o_orderpriority) over w as p, o_orderpriority as q, lag(o_orderstatus) over w as s, o_orderstatus as t from (select *, 'c' || o_custkey as o_clerk from orders) window w as (partition by o_custkey order by o_orderkey))
 select id, (row_number() over (partition by id order by n) - 1)::int as place, line from (select id, 1 as n, 'project ' || p || ' in the tree, ' || q || ' deployed' as line from d where p <> q union all select id, 2, 'tracks ' || s || ' in the tree, ' || t || ' deployed' from d where s <> t
 union all select id, 3, 'pins ' || p || ', ' || s || ' in the tree; running ' || case when t = 'P' then 'nothing' else t end from d where p is not null)""")
def merge_drift_lines(spark, sf_dir):
    """Each order is a deployment that the tree knows as the customer's order before."""
    d = part(spark, sf_dir, "select o_orderkey as id, lag(o_orderpriority) over w as p, o_orderpriority as project, lag(o_orderstatus) over w as s, o_orderstatus as targetRevision from {orders} window w as (partition by o_custkey order by o_orderkey)")
    none = F.lit(None).cast("string")
    drift = F.struct(F.when(F.col("p") != F.col("project"), F.col("p")).alias("project"), none.alias("cluster"), F.lit("").alias("namespace"), none.alias("path"), F.when(F.col("s") != F.col("targetRevision"), F.col("s")).alias("targetRevision"), F.when(F.col("p").isNotNull(), F.array("p", "s")).alias("images"))
    d = d.select("id", "project", none.alias("cluster"), none.alias("namespace"), none.alias("path"), "targetRevision", F.when(F.col("targetRevision") != "P", F.array("targetRevision")).alias("images"), drift.alias("drift"))
    return usages.drift_lines(d, ["id"])


@query(r"""with w as (select event_id, user_id, 'Plug ' || event_type as plugin, case when event_id % 5 = 0 then 'src/a.go: ' else '' end || event_type || ' of "' || user_id || '" took ' || event_id as message from events),
 f as (select *, case when event_id % 5 = 0 then ' ' else '' end || event_type || ' of <value> took #' as raw from w join (select event_id as e, event_type from events) on e = event_id),
 h as (select event_id, user_id, plugin, event_type, list_reduce(list_concat([2166136261::bigint], list_transform(string_split(trim(raw), ''), lambda x: ord(x)::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) as h from f),
 c as (select event_id, user_id, plugin, case when event_type = 'error' then 'failure' when event_type = 'click' then 'press' else 'plugin.plug-' || event_type || '.other-' ||
  ltrim(list_aggregate(list_transform([6, 5, 4, 3, 2, 1, 0], lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36 ** k)::bigint) % 36 + 1)::int, 1)), 'string_agg', ''), '0') end as rule, case when event_type = 'error' then 'error' else 'warning' end as severity from h),
 n as (select *, count(*) over (partition by user_id, plugin, rule, severity) as count from c)
 select event_id, rule, severity, count, case when rule = 'press' and count <= 3 then 'few' when event_id % 5 = 0 and severity <> 'error' then 'known file' end as reason from n""")
def table_suppressed_warnings(spark, sf_dir):
    """Events are warnings of their user's run; two policies hide few presses, and what a file is known for."""
    w = part(spark, sf_dir, """select event_id, user_id, concat('Plug ', event_type) as plugin, '' as project, 'build' as phase,
     concat(case when event_id % 5 = 0 then 'src/a.go: ' else '' end, event_type, ' of "', user_id, '" took ', event_id) as message from {events}""")
    policies = [warnings.Policy('rule == "press" && count <= 3', "few"), warnings.Policy('ref == "src/a.go" && severity != "error"', "known file"), warnings.Policy("true", "never", "note")]
    return warnings.diagnose(w, [(r"\berror\b", "failure", "error"), ("^(src/a.go: )?CLICK", "press", "warning")], policies, ["user_id"]).select("event_id", "rule", "severity", "count", "reason")


@query("""with b as (select distinct s_nationkey as c, l_partkey as d from lineitem join supplier on l_suppkey = s_suppkey where l_returnflag = 'R' and l_tax > 0.06) select a.c as "left", b.c as "right", a.d as def from b a join b on a.d = b.d where a.c < b.c""")
def graph_shared_kernel(spark, sf_dir):
    return usages.shared_kernel(part(spark, sf_dir, "select s_nationkey as context, l_partkey as def from {lineitem} join {supplier} on l_suppkey = s_suppkey where l_returnflag = 'R' and l_tax > 0.06"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') and c_custkey not in (select o_orderkey % 100 from orders where o_orderstatus = 'P')")
def graph_isolated(spark, sf_dir):
    edges = part(spark, sf_dir, "select o_custkey as s, o_orderkey % 100 as t from {orders} where o_orderstatus = 'P'")
    return usages.isolated(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", edges, "s", "t")


@query("""select distinct event, kind, "by" from (select unnest(case when p_size < 25 then [p_brand, p_type] else [p_brand] end) as event, 'operation' as kind, p_partkey::varchar as "by" from part union all select p_type, 'transition', p_size || ' ' || p_brand || ' ' || (p_size + 1) from part where p_size > 10)""")
def usage_emitters(spark, sf_dir):
    operations = part(spark, sf_dir, "select p_partkey as id, case when p_size < 25 then array(p_brand, p_type) else array(p_brand) end as emits from {part}")
    moves = part(spark, sf_dir, "select cast(p_size as varchar(9)) as `from`, p_brand as `on`, cast(p_size + 1 as varchar(9)) as `to`, case when p_size > 10 then p_type else '' end as emits from {part}")
    return usages.emitters(operations, moves)


@query("""with recursive e as (select distinct source, target from (select p_partkey // 2 as source, p_partkey as target from part where p_partkey > 1 union all select p_partkey // 3, p_partkey from part where p_partkey % 3 = 0 and p_partkey > 0)), d(node, depth) as (select target, 1 from e where source in (2, 5) union select target, depth + 1 from d join e on node = source) select node, min(depth) as depth from d group by 1""")
def graph_command_chain(spark, sf_dir):
    """What a command's events (2 and 5) set going: the chain from several seeds at once."""
    seeds = spark.createDataFrame([(2,), (5,)], "root long")
    return graph.closure(_derived(spark, sf_dir), "source", "target", seeds).groupBy("node").agg(F.min("depth").alias("depth"))


@query("select c_custkey, row_number() over (order by c_mktsegment, c_nationkey desc, c_custkey) as place from customer")
def table_grouped_sort(spark, sf_dir):
    """The group column sorts first, whatever is asked for."""
    return tables.numbered(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), [F.col("c_mktsegment"), -F.col("c_nationkey"), F.col("c_custkey")]).select("c_custkey", "place")


@query(r"""select distinct source, regexp_replace(lower(source), '[^a-z0-9+#]', '', 'g') || '/' || 'nodejsc++' as tech from documents""")
def text_tech_keys(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source").distinct()
    return d.select("source", F.concat_ws("/", usages.tech_key(F.col("source")), usages.tech_key(F.lit("Node.js C++"))).alias("tech"))
