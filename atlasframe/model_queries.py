"""Operators on flows, shapes, links and sources, bound to the relational test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasframe.estate_queries import part, sub
from atlasframe.functions import text as fn
from atlasframe.operators import diff, flows, graph, merge, relations, resolve, search, shapes, specs, tables, traces, usages
from atlasframe.plans import checks, enrich
from atlasframe.queries import query, read
from atlasframe.sources import owners

# Flows: an order is a flow, its lines are steps, in the order of their part.

NODES = """select cast(l_orderkey as varchar(20)) as flow_id, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_extendedprice) as ord, l_returnflag as flag, l_linestatus as line, l_suppkey as supplier, l_partkey as part from {lineitem}"""


def _nodes(spark, sf_dir):
    n = part(spark, sf_dir, NODES).withColumn("ord", F.col("ord").cast("long"))
    status = F.when(F.col("flag") == "R", "unresolved").when(F.col("flag") == "A", "declared").otherwise("verified")
    path = F.when(F.col("line") == "F", F.array(F.concat_ws(":", F.lit("alt"), F.col("supplier") % 2, F.lit("0")))).otherwise(F.array().cast("array<string>"))
    return n.select(
        "flow_id", "ord", F.concat(F.lit("s"), "ord").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("step").alias("type"), F.lit(None).cast("long").alias("branch"), path.alias("path"),
        F.concat(F.lit("l"), F.col("supplier") % 7).alias("from"), F.concat(F.lit("l"), F.col("part") % 7).alias("to"), F.when(F.col("flag") == "N", "rpc").otherwise("event").alias("kind"), F.concat(F.lit("r"), "part").alias("ref"), F.lit(None).cast("string").alias("label"), status.alias("status"),
    )


PARTICIPANTS = "select distinct cast(l_orderkey as varchar(20)) as flow, 'l' || (l_suppkey % 7) as id, case when l_suppkey % 7 < 6 then 'c' || (l_suppkey % 3) end as context from {lineitem}"
LANE = "case when {0} % 7 < 6 then {1} end"


@query(f"select flow, array_to_string(list_sort(list_distinct(list(context))), '+') as contexts, count(distinct context) as reach from {sub(PARTICIPANTS)} where context is not null group by 1")
def flow_contexts(spark, sf_dir):
    return flows.flow_contexts(part(spark, sf_dir, PARTICIPANTS)).select("flow", F.array_join("contexts", "+").alias("contexts"), F.col("reach").cast("long").alias("reach"))


@query(f"""with p as (select distinct flow, id, context from {sub(PARTICIPANTS)}), p1 as (select flow, id, min(context) as context from p group by 1, 2), n as (select *, 'l' || (supplier % 7) as f, 'l' || (part % 7) as t from {sub(NODES)})
 select n.flow_id, n.ord, coalesce(a.context <> b.context, false) as crosses from n left join p1 a on a.flow = n.flow_id and a.id = f left join p1 b on b.flow = n.flow_id and b.id = t""")
def flow_crossings(spark, sf_dir):
    lanes = part(spark, sf_dir, PARTICIPANTS).groupBy("flow", "id").agg(F.min("context").alias("context"))
    return flows.with_lane_contexts(_nodes(spark, sf_dir), lanes).select("flow_id", "ord", "crosses")


@query(f"""with n as (select flow_id, ord, flag, case when line = 'F' then (supplier % 2)::varchar else '' end as k from {sub(NODES)}), m as (select *, case when k <> lag(k) over w or lag(k) over w is null then 1 else 0 end as new from n window w as (partition by flow_id order by ord)),
 c as (select *, sum(new) over (partition by flow_id order by ord) as chapter from m) select flow_id, chapter::bigint as chapter, case when k = '' then 'steps' else 'alt' end as kind, min(ord) as first, max(ord) as last, count(*) as steps, count(*) filter (flag = 'N') as verified, count(*) filter (flag = 'A') as declared, count(*) filter (flag = 'R') as unresolved from c group by all""")
def flow_chapters(spark, sf_dir):
    return flows.chapters(_nodes(spark, sf_dir))


@query(f"""with s as (select flow_id, ord, 's' || ord as step_id, 'r' || part as ref, case flag when 'N' then 'rpc' else 'event' end as kind, 'l' || (part % 7) as t from {sub(NODES)}), o as (select flow_id as next_flow, ref, kind, t from s where ord = 1),
 e as (select o_orderkey::varchar as next_flow, 'r' || (o_custkey + 50) as ref from orders where o_orderstatus = 'P'), a as (select s.flow_id, step_id, next_flow, 1 as rank from s join e using (ref) union all select s.flow_id, step_id, next_flow, case s.kind when 'rpc' then 3 else 4 end from s join o on o.ref = s.ref and o.kind = s.kind and (s.kind = 'event' or o.t = s.t)),
 b as (select *, min(rank) over (partition by flow_id, step_id) as best from a where flow_id <> next_flow) select distinct flow_id, step_id, next_flow, case rank when 1 then 'entrypoint' when 3 then 'contract' else 'event' end as basis from b where rank = best""")
def flow_continuations(spark, sf_dir):
    entries = part(spark, sf_dir, "select cast(o_orderkey as varchar(20)) as id, case when o_orderstatus = 'P' then 'r' || (o_custkey + 50) else '' end as entrypoint from {orders}")
    return flows.continuations(_nodes(spark, sf_dir), entries)


@query("""with hops as (select distinct l_suppkey as service, l_partkey as event, l_orderkey from lineitem), r as (select l_orderkey::varchar as flow_id, l_suppkey as service, l_partkey as event, l_linenumber as ord, l_linestatus as b from lineitem where l_returnflag = 'A'), s as (select l_orderkey::varchar as flow_id, l_suppkey as service, l_partkey as published, l_linenumber as ord, l_linestatus as b from lineitem where l_returnflag = 'R')
 select r.event, r.service, s.published, min(r.flow_id) as flow_id from r join s on r.flow_id = s.flow_id and r.service = s.service and s.ord > r.ord and (r.b = 'O' or s.b = r.b) where true group by 1, 2, 3""")
def flow_event_hops(spark, sf_dir):
    """A service receives what is accepted and publishes what is returned; lines of status F lie in one branch that ends the flow."""
    li = part(spark, sf_dir, "select cast(l_orderkey as varchar(20)) as flow_id, cast(l_linenumber as bigint) as ord, cast(l_linenumber as varchar(9)) as node_id, l_returnflag as flag, l_linestatus as line, l_suppkey as supplier, l_partkey as ref from {lineitem} where l_returnflag <> 'N'")
    own = F.col("supplier").cast("string")
    n = li.select("flow_id", "ord", "node_id", F.lit("step").alias("type"), F.lit("event").alias("kind"), "ref", F.when(F.col("line") == "F", F.array(F.lit("alt:1:0:end"))).otherwise(F.array().cast("array<string>")).alias("path"),
        F.when(F.col("flag") == "A", "x").otherwise(own).alias("from"), F.when(F.col("flag") == "A", own).otherwise("x").alias("to"))
    publishers = li.where("flag = 'R'").select(F.col("ref").alias("event"), own.alias("service")).distinct()
    return flows.event_hops(n, publishers).select("event", F.col("service").cast("long").alias("service"), "published", "flow_id")


# Shapes

TYPES = "select p_partkey, case p_size % 8 when 0 then p_brand when 1 then 'Vec<' || p_type || '>' when 2 then '[]*' || p_type when 3 then 'Option<Box<' || p_type || '>>' when 4 then 'map<string, ' || p_type || '>' when 5 then p_type || ' | null' when 6 then 'optional ' || p_type when 7 then 'repeated ' || p_type || '?' end as type, p_size % 8 as k, p_type, p_brand from {part}"


@query(f"select p_partkey, case k when 0 then p_brand else p_type end as base, k in (1, 2, 4, 7) as many, k in (2, 3, 5, 6, 7) as optional, k = 4 as by_key from {sub(TYPES)}")
def shape_type_parts(spark, sf_dir):
    return part(spark, sf_dir, TYPES).select("p_partkey", shapes.type_parts(F.col("type")).alias("t")).select("p_partkey", "t.*")


@query("""with d as (select * from (values ('varchar(64)', 'text'), ('BIGINT', 'int64'), ('numeric(10,2)', 'decimal'), ('Timestamp  with time zone', 'time'), ('odd', 'unknown'), ('int4', 'int32')) d(db, a)), m as (select * from (values ('*string', 'text'), ('int', 'int'), ('[]byte', 'bytes'), ('Instant', 'time'), ('Money', 'unknown'), ('long', 'int64')) m(model, b))
 select o_orderkey, db, model, a <> 'unknown' and b <> 'unknown' and a <> b and not (b = 'int' and a in ('int64', 'int32')) as disagree from (select o_orderkey, o_orderkey % 6 as i, o_custkey % 6 as j from orders) o join (select *, row_number() over () - 1 as i from d) d using (i) join (select *, row_number() over () - 1 as j from m) m using (j)""")
def shape_types_disagree(spark, sf_dir):
    db, model = (F.array(*map(F.lit, x)) for x in (["varchar(64)", "BIGINT", "numeric(10,2)", "Timestamp  with time zone", "odd", "int4"], ["*string", "int", "[]byte", "Instant", "Money", "long"]))
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.get(db, (F.col("o_orderkey") % 6).cast("int")).alias("db"), F.get(model, (F.col("o_custkey") % 6).cast("int")).alias("model"))
    return o.select("o_orderkey", "db", "model", shapes.types_disagree(F.col("db"), F.col("model")).alias("disagree"))


@query("""with m as (select s_nationkey as interface, s_suppkey as name, case when s_suppkey % 11 = 0 then null else 'f' || (s_suppkey % 4) end as f from supplier), n as (select interface, count(f) as n from m group by 1), c as (select interface, f, count(*) as c from m group by 1, 2)
 select m.interface, m.name, case when n >= 3 and c >= 2 then m.f end as family from m join n using (interface) left join c on c.interface = m.interface and c.f = m.f""")
def shape_method_groups(spark, sf_dir):
    m = part(spark, sf_dir, "select s_nationkey as interface, s_suppkey as name, case when s_suppkey % 11 = 0 then null when s_suppkey % 2 = 0 then '/api/v1/f' || (s_suppkey % 4) || '/@id' else '/f' || (s_suppkey % 4) end as path from {supplier}")
    return shapes.method_groups(m.withColumn("path", F.replace("path", F.lit("@id"), F.lit("{id}"))), least=3)


@query("""with c as (select l_suppkey as service, 'p' || (l_partkey % 40) as peer, case when l_returnflag = 'R' then 'http-client/x' when l_returnflag = 'A' then 'soap/y' else 'Api/' || l_linenumber end as id from lineitem), k as (select 'p' || p_partkey as peer, 'service' as kind from part where p_partkey < 10 union all select 'p' || p_partkey, 'external' from part where p_partkey between 10 and 19)
 select service, c.peer, coalesce(kind, 'unresolved') as kind, count(*) as operations, count(*) filter (kind = 'service' and id = 'Api/1') as documented, array_to_string(list_sort(list_distinct(list(case when starts_with(id, 'soap/') then 'SOAP' when starts_with(id, 'http-client/') then 'HTTP' else 'RPC' end))), '+') as protocols from c left join k on k.peer = c.peer group by 1, 2, 3""")
def shape_integrations(spark, sf_dir):
    calls = part(spark, sf_dir, "select l_suppkey as service, 'p' || (l_partkey % 40) as peer, case when l_returnflag = 'R' then 'http-client/x' when l_returnflag = 'A' then 'soap/y' else 'Api/' || l_linenumber end as id from {lineitem}")
    known = lambda test: part(spark, sf_dir, f"select 'p' || p_partkey as id from {{part}} where {test}")
    served = known("p_partkey < 10").select(F.col("id").alias("service"), F.lit("Api/1").alias("id"), F.lit(False).alias("http"))
    return shapes.integrations(calls, served, known("p_partkey < 10"), known("p_partkey between 10 and 19")).withColumn("protocols", F.array_join("protocols", "+"))


COPY_A = "select o_custkey as copy, o_orderpriority as message, o_orderstatus as field, cast(count(*) as varchar(9)) as type from {orders} where o_orderdate < timestamp '1998-01-01' group by o_custkey, o_orderpriority, o_orderstatus"
COPY_B = COPY_A.replace("<", ">=")


@query(f"""with j as (select coalesce(a.copy, b.copy) as copy, coalesce(a.message, b.message) || '.' || coalesce(a.field, b.field) as n, a.type as a, b.type as b from {sub(COPY_A)} a full join {sub(COPY_B)} b on a.copy = b.copy and a.message = b.message and a.field = b.field)
 select copy, array_to_string(list_sort(list(case when b is null then n || ' is not published' when a is null then n || ' is missing' else n || ' is ' || a || ', published as ' || b end)), '; ') as differences from j where a is distinct from b group by 1""")
def shape_copy_differences(spark, sf_dir):
    return shapes.field_differences(part(spark, sf_dir, COPY_A), part(spark, sf_dir, COPY_B)).withColumn("differences", F.array_join("differences", "; "))


@query("""with f as (select l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey as field_id, p_brand as b, l_suppkey % 10 as aggregate, l_suppkey % 3 as service from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R'), s as (select 'x' || p_partkey as id, p_brand as name, p_partkey % 10 as aggregate, p_partkey % 3 as service from part),
 own as (select aggregate, name, min(id) as id from s group by 1, 2), near as (select service, name, min(id) as id from s group by 1, 2) select field_id, case when coalesce(own.id, near.id) is not null then 'block' end as kind, coalesce(own.id, near.id) as shape from f left join own on own.aggregate = f.aggregate and own.name = f.b left join near on near.service = f.service and near.name = f.b""")
def shape_resolved(spark, sf_dir):
    fields = part(spark, sf_dir, "select concat_ws('/', l_orderkey, l_linenumber, l_partkey, l_suppkey) as field_id, '[]' || p_brand as type, l_suppkey % 10 as aggregate, l_suppkey % 3 as service, cast(null as string) as ref from {lineitem} join {part} on l_partkey = p_partkey where l_returnflag = 'R'")
    blocks = part(spark, sf_dir, "select 'x' || p_partkey as id, p_brand as name, p_partkey % 10 as aggregate, p_partkey % 3 as service from {part}")
    return shapes.resolve_shapes(fields, spark.createDataFrame([("none",)], "def_id string"), blocks, blocks.limit(0)).select("field_id", "kind", "shape")


# Links and claims

@query("""with m as (select l_partkey % 50 as address, l_suppkey % 20 as message, s_nationkey as service, case l_returnflag when 'R' then 'send' else 'receive' end as direction from lineitem join supplier on l_suppkey = s_suppkey), c as (select distinct * from m), p as (select address, message, count(distinct service) as n from c where direction = 'send' group by 1, 2)
 select c.address, c.message, c.service, c.direction, coalesce(n, 0) as publishers, case when n > 1 then 'multiple publishers' when direction = 'receive' and n is null then 'no publisher' end as issue from c left join p on p.address = c.address and p.message = c.message""")
def link_messaging_claims(spark, sf_dir):
    m = part(spark, sf_dir, "select l_partkey % 50 as address, l_suppkey % 20 as name, s_nationkey as service, case l_returnflag when 'R' then 'send' else 'receive' end as direction from {lineitem} join {supplier} on l_suppkey = s_suppkey")
    events = spark.createDataFrame([], "service int, wire struct<name: bigint, channel: bigint>")
    return relations.messaging_claims({"channel_messages": m, "events": events, "channels": m.select("address", "service").distinct()})


ACCESS = "select l_suppkey % 5 as store, l_suppkey as relation, c_nationkey as service, case l_returnflag when 'N' then 'read' when 'A' then 'write' else 'delete' end as operation from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey where l_tax > 0.05"


@query(f"""with a as {sub(ACCESS)}, r as (select relation, count(distinct service) filter (operation <> 'read') as w, count(distinct service) as s from a group by 1)
 select store, a.relation, service, array_to_string(list_sort(list_distinct(list(operation))), '+') as operations, any_value(case when w > 1 then 2 when s > 1 then 1 else 0 end) as shared from a join r on r.relation = a.relation group by 1, 2, 3""")
def link_store_matrix(spark, sf_dir):
    return relations.store_matrix(part(spark, sf_dir, ACCESS))


@query("""select 'fk' as kind, 'o' || o_orderkey || '.k' as "column", 'c' || o_custkey || '.id' as target, o_custkey % 3 as store, o_custkey % 4 as other_store from orders where o_custkey % 3 <> o_custkey % 4 and o_custkey in (select c_custkey from customer)""")
def link_cross_stores(spark, sf_dir):
    columns = part(spark, sf_dir, "select 'o' || o_orderkey as relation, 'k' as name, o_custkey % 3 as store, named_struct('table', 'c' || o_custkey, 'column', 'id') as fk, cast(null as array<string>) as `from` from {orders}")
    return relations.cross_store_references({"relations": part(spark, sf_dir, "select 'c' || c_custkey as id, c_custkey % 4 as store from {customer}"), "columns": columns})


@query("select p_partkey as term, p_size as context, slug, kind, id from (select p_partkey, p_size, lower(p_brand) as slug from part where p_partkey % 2 = 0) join (select p_size as c, lower(p_brand) as s, 'block' as kind, 'x' || p_partkey as id from part where p_partkey % 2 = 1) on c = p_size and s = slug")
def link_terms(spark, sf_dir):
    term = part(spark, sf_dir, "select p_partkey as id, p_size as context, lower(p_brand) as slug from {part} where p_partkey % 2 = 0")
    block = part(spark, sf_dir, "select p_size as context, lower(p_brand) as slug, 'x' || p_partkey as id from {part} where p_partkey % 2 = 1")
    none = block.limit(0)
    return relations.term_bindings({"terms": term, "blocks": block, "aggregates": none, "events": none, "services": none})


@query("select p_partkey as id, p_size as aggregate, p_brand as service, p_type as kind from part where p_partkey % 3 <> 0")
def link_unexposed(spark, sf_dir):
    return relations.unexposed_operations({"operations": part(spark, sf_dir, "select p_partkey as id, p_size as aggregate, p_brand as service, p_type as kind, case when p_partkey % 3 = 0 then array('m') when p_partkey % 3 = 1 then cast(array() as array<string>) end as exposedBy from {part}")})


@query("select c_nationkey as context, count(*) as services from customer where c_custkey in (select o_custkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')) group by 1")
def link_narrowed(spark, sf_dir):
    services = part(spark, sf_dir, "select c_custkey as id, c_nationkey as context from {customer}")
    none = services.select(F.col("id").alias("service")).limit(0)
    t = {"deployments": part(spark, sf_dir, "select o_custkey as service, o_orderpriority as environment from {orders}"), "services": services, "contexts": services.select(F.col("context").alias("id")).distinct()}
    t |= {n: none for n in ("calls", "interfaces", "methods", "channels", "channel_messages", "aggregates", "events", "operations", "consumers")}
    return relations.narrowed(t, ["1-URGENT", "2-HIGH"])["services"].groupBy("context").agg(F.count("*").alias("services"))


@query("select l_orderkey || '/' || l_linenumber || '/' || l_suppkey || '/' || l_partkey as node_id, case when l_returnflag <> 'N' then p_partkey end as ref from lineitem join part on l_partkey = p_partkey")
def enrich_wire_names(spark, sf_dir):
    """Accepted lines name their event in full, returned ones by its last segment, which is unique; the others aren't steps of events."""
    events = part(spark, sf_dir, "select p_partkey as id, named_struct('name', p_brand || '.' || p_partkey) as wire from {part}")
    nodes = part(spark, sf_dir, "select concat_ws('/', l_orderkey, l_linenumber, l_suppkey, l_partkey) as node_id, 'step' as type, case when l_returnflag = 'N' then 'rpc' else 'event' end as kind, cast(null as bigint) as ref, 'unresolved' as status, case when l_returnflag = 'A' then p_brand || '.' || p_partkey else cast(p_partkey as string) end as label from {lineitem} join {part} on l_partkey = p_partkey")
    return enrich.wire_names({"events": events, "flow_nodes": nodes}).select("node_id", "ref")


@query("select o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderpriority)) as oldest from orders where o_orderstatus <> 'P' group by 1")
def merge_oldest_stamp(spark, sf_dir):
    o = part(spark, sf_dir, "select o_custkey, case when o_orderstatus = 'P' then 'unknown' else cast(o_orderdate as string) end as stamp, o_orderpriority from {orders}")
    return o.groupBy("o_custkey").agg(merge.oldest(F.col("stamp"), F.col("o_orderpriority")).alias("oldest")).where("oldest is not null")


@query(r"""with p as (select page_id, list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> '') as s from pages) select page_id, '/' || array_to_string(s[n:], '/') as suffix from p, unnest(range(1, greatest(len(s), 1) + 1)) t(n)""")
def resolve_suffixes(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(resolve.suffixes_of(resolve.route_shape(F.col("url")))).alias("suffix"))


@query("""select o_orderkey, c_nationkey as publisher_context, o_orderkey % 25 as consumer_context from orders join customer on o_custkey = c_custkey where o_orderstatus in ('F', 'P') and (c_nationkey in (1, 2, 3) or o_orderkey % 25 in (1, 2, 3))""")
def graph_filtered_events(spark, sf_dir):
    edges = part(spark, sf_dir, "select o_orderkey, c_nationkey as publisher_context, o_orderkey % 25 as consumer_context, o_orderstatus as status from {orders} join {customer} on o_custkey = c_custkey")
    return graph.filter_event_graph(edges, [1, 2, 3], ["F", "P"]).drop("status")


@query("""with recursive e as (select distinct p_size as s, (p_size * 3) % 50 as t from part), s as (select s as state from e union select t from e), r(node, depth) as (select 1, 0 union select t, depth + 1 from r join e on s = node where depth < 50), m as (select node, min(depth) as d from r group by 1)
 select state, coalesce(d, (select max(d) from m) + 1) as "column", state not in (select s from e where s <> t) as terminal from s left join m on node = state""")
def graph_lifecycle(spark, sf_dir):
    moves = part(spark, sf_dir, "select distinct p_size as source, (p_size * 3) % 50 as target from {part}")
    states = moves.select(F.col("source").alias("state")).union(moves.select("target")).distinct()
    return graph.lifecycle_columns(moves, states, 1)


# Tables, text and sources

@query("""select c_custkey, row_number() over (order by lower(c_mktsegment) desc, c_acctbal, c_custkey) as place from customer""")
def table_sorted(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    assert tables.sorted_by(c, "c_mktsegment.desc,c_acctbal.asc,none.asc", {"c_mktsegment": "text", "c_acctbal": "number"}).columns == c.columns
    segment = F.dense_rank().over
    from pyspark.sql import Window

    ranks = c.select("c_mktsegment").distinct().withColumn("_r", segment(Window.orderBy(*tables.sort_keys("c_mktsegment", "text", True))))  # five segments
    return tables.numbered(c.join(F.broadcast(ranks), "c_mktsegment"), [F.col("_r"), F.col("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "place")


@query(r"""select event_id, case when s < 60 then 'just now' when s < 3600 then (s // 60) || case when s // 60 = 1 then ' minute' else ' minutes' end || ' ago' when s < 86400 then (s // 3600) || case when s // 3600 = 1 then ' hour' else ' hours' end || ' ago'
 when s < 2592000 then (s // 86400) || case when s // 86400 = 1 then ' day' else ' days' end || ' ago' else (s // 2592000) || case when s // 2592000 = 1 then ' month' else ' months' end || ' ago' end as age from (select event_id, date_diff('microsecond', ts, timestamp '2024-02-01 00:00:00') // 1000000 as s from events)""")
def text_ages(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", fn.relative_time(F.col("ts").cast("timestamp"), F.to_timestamp(F.lit("2024-02-01 00:00:00"))).alias("age"))


@query(r"""select p_partkey, case p_size % 4 when 0 then 'github.com/acme/' when 1 then 'host.x/acme/' when 2 then 'github.com/acme/' else 'go.dev/acme/' end || lower(p_brand) as repo, p_partkey as line, 'src/' || p_name as path,
 case when p_size % 2 = 0 then '"a ""' || p_name || '"' else '''=' || p_name end as cell, p_name || '\|' || p_type as md from part""")
def text_sources(spark, sf_dir):
    p = part(spark, sf_dir, "select p_partkey, p_size, p_name, p_type, case p_size % 4 when 0 then 'https://github.com/Acme/' || p_brand || '.git' when 1 then 'ssh://git@host.x:22/acme/' || p_brand || '/' when 2 then 'git@github.com:acme/' || p_brand || '.git' else 'go.dev/acme/' || p_brand end as repo from {part}")
    at = fn.source_line(F.concat(F.lit("src/"), "p_name", F.lit(":"), "p_partkey"))
    cell = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('a "'), "p_name")).otherwise(F.concat(F.lit("="), "p_name"))
    return p.select("p_partkey", fn.repo_name(F.col("repo")).alias("repo"), at["line"].cast("long").alias("line"), at["path"].alias("path"), fn.csv_cell(cell).alias("cell"), fn.markdown_cell(F.concat_ws("|", "p_name", "p_type")).alias("md"))


@query(r"""select p_partkey, commit from (select p_partkey, 'github.com/acme/' || (p_partkey % 40) as r from part) join (select 'github.com/acme/' || s_suppkey as r, 'c' || s_suppkey as commit from supplier where s_suppkey < 30) using (r)""")
def text_pins(spark, sf_dir):
    repos = part(spark, sf_dir, "select p_partkey, 'git@github.com:Acme/' || (p_partkey % 40) || '.git' as repo from {part}").withColumn("_r", fn.repo_name(F.col("repo")))
    pins = part(spark, sf_dir, "select 'https://github.com/acme/' || s_suppkey as pin, 'c' || s_suppkey as commit from {supplier} where s_suppkey < 30").withColumn("_r", fn.repo_name(F.col("pin")))
    return repos.join(pins, "_r").select("p_partkey", "commit")


@query(r"""select o_orderkey, 'AB-' || o_custkey || case when o_custkey <> o_orderkey % 100 then '+CD-' || (o_orderkey % 100) else '+CD-' || (o_orderkey % 100) end as keys from orders""")
def text_issue_keys(spark, sf_dir):
    o = part(spark, sf_dir, "select o_orderkey, 'fix AB-' || o_custkey || ', CD-' || (o_orderkey % 100) || ' (AB-' || o_custkey || ') XX-1' as subject from {orders}")
    return o.select("o_orderkey", F.array_join(fn.issue_keys(F.col("subject"), ["AB", "CD"]), "+").alias("keys"))


@query(r"""with log as (select o_custkey as repo, o_orderkey, o_orderdate, 'AB-' || (o_orderkey % 50) as key from orders), t as (select l_orderkey, 'src/' || (l_partkey % 20) as path from lineitem) select key, path, count(distinct o_orderkey) as commits from log join t on l_orderkey = o_orderkey group by 1, 2""")
def source_work_items(spark, sf_dir):
    """Commit logs, one for each customer: an order is a commit, its lines are the paths that it changed."""
    heads = part(spark, sf_dir, "select o_custkey as repo, o_orderkey as c, 0 as n, lpad(lower(hex(o_orderkey)), 8, '0') || '|' || date_format(o_orderdate, 'yyyy-MM-dd') || '|AB-' || (o_orderkey % 50) || ' done' as line from {orders}")
    body = part(spark, sf_dir, "select o_custkey as repo, o_orderkey as c, n, 'src/' || (l_partkey % 20) as line from (select l_orderkey, l_partkey, 1 + cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey) as int) as n from {lineitem}) join {orders} on l_orderkey = o_orderkey")
    log = owners.parse_log(heads.unionByName(body), "line", ["c", "n"], ["repo"])
    return owners.work_items(log, ["AB"]).select("key", "path", "commits")


@query(r"""with p as (select page_id, regexp_replace(url, '[?#].*$', '') as u from pages) select page_id, case when ends_with(u, '.html') then 'web' when starts_with(u, '/de/') then 'german' when regexp_matches(u, '^/[ef][a-z]/') then 'west' else 'all' end as owner from p""")
def source_owned_paths(spark, sf_dir):
    text = "* all\n/[ef]?/ west # by letter\n/de/ german\n*.html web\n"
    found = owners.owner_rules(spark.createDataFrame([(text,)], "text string"), "text")
    paths = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return owners.owners_of(paths, "path", found).select("page_id", F.array_join("owners", "+").alias("owner"))


@query("""select event_id, case when event_type = 'view' then 'http' when event_type = 'click' then 'rpc' when event_type = 'purchase' then 'db' when event_type = 'signup' then 'send' end as hop from events""")
def trace_hop_kinds(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    names = {"view": "http.request.method", "click": "rpc.service", "purchase": "db.system.name", "signup": "messaging.operation.type"}
    a = F.when(F.lit(False), F.map_from_arrays(F.array(F.lit("x")), F.array(F.lit("x"))))
    for event, name in names.items():
        a = a.when(F.col("event_type") == event, F.create_map(F.lit(name), F.lit("send")))
    kind = F.when(F.col("event_type") == "signup", 1).otherwise(3)
    return e.select("event_id", traces.hop_kind(kind, F.coalesce(a, F.create_map(F.lit("x"), F.lit("x")))).alias("hop"))


@query("""select o_orderpriority || '/' || o_orderstatus as k, case when o_orderstatus = 'P' and o_orderpriority <> '5-LOW' then 'breaking' else 'change' end as severity, count(*) as rows from orders group by 1, 2""")
def diff_status_severity(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    before = F.when(F.col("o_orderpriority") == "5-LOW", "unresolved").otherwise("declared")
    after = F.when(F.col("o_orderstatus") == "P", "unresolved").when(F.col("o_orderstatus") == "O", "declared").otherwise("verified")
    return o.groupBy(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("k"), diff.status_severity(before, after).alias("severity")).agg(F.count("*").alias("rows"))


@query("select p_partkey, case when p_partkey in (select c_custkey from customer) then 'customer' else 'part' end as kind from part")
def search_resolved(spark, sf_dir):
    p, c = read(spark, sf_dir, "part", "customer")
    found = search.resources((p, "part", "p_partkey", "p_name", ["p_name"]), (c, "customer", "c_custkey", "c_name", ["c_name"]))
    ids = p.select(F.col("p_partkey").cast("string").alias("id"))
    return search.resolved(ids, found).select(F.col("id").cast("long").alias("p_partkey"), "kind")


@query("""select 'houses' as relation, 'c' || c_custkey as target from customer where c_nationkey = 3 union all select 'lies-in', 'r' || n_regionkey from nation where n_nationkey = 3""")
def search_around(spark, sf_dir):
    from atlasframe.queries import QUERIES

    return search.around(QUERIES["graph_related"](spark, sf_dir), "n3")


@query("""with l as (select distinct n_regionkey as u, n_regionkey as d, 0 as n from nation limit 0), k as (select a.n_regionkey as x, b.n_regionkey as y, s.p as def from (select distinct l_partkey as p, s_nationkey as n from lineitem join supplier on l_suppkey = s_suppkey where l_tax > 0.075) s join nation a on s.n = a.n_nationkey join (select distinct l_partkey as p, s_nationkey as n from lineitem join supplier on l_suppkey = s_suppkey where l_tax > 0.075) t on t.p = s.p join nation b on t.n = b.n_nationkey where a.n_regionkey < b.n_regionkey)
 select a.r_regionkey as "left", b.r_regionkey as "right", 0 as weight, count(distinct def) as shared, case when count(distinct def) > 0 then 'shared-kernel' else 'separate-ways' end as pattern from region a join region b on a.r_regionkey < b.r_regionkey left join k on k.x = a.r_regionkey and k.y = b.r_regionkey group by 1, 2""")
def graph_kernel_map(spark, sf_dir):
    blocks = part(spark, sf_dir, "select n_regionkey as context, l_partkey as def from {lineitem} join {supplier} on l_suppkey = s_suppkey join {nation} on s_nationkey = n_nationkey where l_tax > 0.075")
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("context"), F.col("r_regionkey").alias("place"))
    links = spark.createDataFrame([], "upstream int, downstream int")
    return graph.context_map(region, links, "place", usages.shared_kernel(blocks)).select("left", "right", "weight", "shared", "pattern")


@query("""select 'spec' || (o_custkey % 7) as subject, 'order' as kind, o_orderdate as at, 'o' || o_orderkey as text from orders union all select 'user' || user_id, 'event', ts, event_type from events""")
def spec_activity(spark, sf_dir):
    o = part(spark, sf_dir, "select 'spec' || (o_custkey % 7) as subject, o_orderdate as at, 'o' || o_orderkey as text from {orders}")
    e = part(spark, sf_dir, "select 'user' || user_id as subject, ts as at, event_type as text from {events}")
    return specs.activity((o, "order", "at", "subject", "text"), (e, "event", "at", "subject", "text"))


@query("""select rule, rows::bigint as rows, example, row_number() over (order by rows desc, rule) as place from (select 'p' || p_size as rule, count(*) as rows, min('s' || p_partkey) as example from part group by 1)""")
def catalog_check_summary(spark, sf_dir):
    return checks.summary(part(spark, sf_dir, "select 'p' || p_size as rule, 's' || p_partkey as subject, '' as detail from {part}")).withColumn("place", F.col("place").cast("long"))
