"""Operators bound to the relational test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.functions import text as fn
from atlasframe.operators import diff, graph, merge, resolve, search, tables, traces, validate
from atlasframe.plans import rules, subjects

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, *names: str):
    found = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return found[0] if len(found) == 1 else found


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation -> customer nation, a row per line: the estate's edges in the terms of the tables."""
    li, orders, customer, supplier = read(spark, sf_dir, "lineitem", "orders", "customer", "supplier")
    lines = li.join(orders, li.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    status = F.when(F.col("l_returnflag") == "R", "unresolved").when(F.col("l_returnflag") == "A", "declared").otherwise("verified")
    return lines.select(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target"), status.alias("status"), "l_shipdate", F.col("o_orderpriority").alias("label"))


TRADE = """(select s_nationkey as source, c_nationkey as target, case l_returnflag when 'R' then 'unresolved' when 'A' then 'declared' else 'verified' end as status, o_orderpriority as label
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey)"""


# Merge

@query("select source, lang, doc_id, n_chars from (select *, row_number() over (partition by source, lang order by doc_id) n from documents) where n = 1")
def merge_claim_owners(spark, sf_dir):
    return merge.claim(read(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"])[0]


@query("""select source, lang, doc_id, n_chars, won_by_doc_id from (select *, row_number() over w n, first_value(doc_id) over w as won_by_doc_id
 from documents window w as (partition by source, lang order by doc_id)) where n > 1""")
def merge_claim_conflicts(spark, sf_dir):
    return merge.claim(read(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"])[1]


@query("""select user_id, arg_min(event_type, event_id) filter (event_type <> '') as kind, arg_min(props, event_id) filter (props <> '') as props
 from (select user_id, event_id, case when event_type = 'view' then '' else event_type end as event_type, props from events) group by user_id""")
def merge_first_non_empty(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))
    return merge.first_non_empty(e, ["user_id"], ["kind", "props"], ["event_id"])


@query("""with k as (select c_nationkey, arg_min(c_mktsegment, c_custkey) as kept from customer group by 1)
 select c_nationkey, c_custkey, 'c_mktsegment' as field, c_mktsegment as lost, kept from customer join k using (c_nationkey) where c_mktsegment <> kept""")
def merge_field_conflicts(spark, sf_dir):
    return merge.field_conflicts(read(spark, sf_dir, "customer"), ["c_nationkey"], ["c_mktsegment"], ["c_custkey"])


@query("""select user_id, string_agg(event_type, '+' order by first_id) as kinds from (select user_id, event_type, min(event_id) as first_id from events group by all) group by user_id""")
def merge_union_lists(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("kinds", F.array("event_type"))
    return merge.union_lists(e, ["user_id"], "kinds", ["event_id"]).withColumn("kinds", F.array_join("kinds", "+"))


@query("""select l_orderkey, case min(case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end) when 0 then 'verified' when 1 then 'declared' else 'unresolved' end as status,
 min(l_linestatus) as note from lineitem group by 1""")
def merge_raise_status(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "verified").when(F.col("l_returnflag") == "A", "declared").otherwise("unresolved")
    return merge.raise_status(li.select("l_orderkey", status.alias("status"), F.col("l_linestatus").alias("note")), ["l_orderkey"], "status", "note", ["note"])


@query("""with a as (select o_custkey, max_by(o_orderstatus, o_orderkey) s, max_by(o_orderpriority, o_orderkey) p from orders where o_orderstatus = 'F' group by 1),
 b as (select o_custkey, max_by(o_orderstatus, o_orderkey) s, max_by(o_orderpriority, o_orderkey) p from orders where o_orderstatus <> 'F' group by 1)
 select coalesce(a.o_custkey, b.o_custkey) as o_custkey, case when a.s is not null then 'api' else 'manifest' end as basis, coalesce(a.s, b.s) as status, coalesce(a.p, b.p) as priority,
 concat_ws('+', case when a.p <> b.p then 'priority' end, case when a.s <> b.s then 'status' end) as drift from a full join b on a.o_custkey = b.o_custkey""")
def merge_deployment_drift(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("basis", F.when(F.col("o_orderstatus") == "F", "api").otherwise("manifest"))
    last = o.groupBy("o_custkey", "basis").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.max_by("o_orderpriority", "o_orderkey").alias("priority"))
    return merge.lay_over(last, ["o_custkey"], "basis", ["status", "priority"], "api", "manifest").withColumn("drift", F.array_join("drift", "+"))


# Resolution

@query("""with n as (select s_nationkey, count(*) c, min(s_suppkey) k from supplier where s_acctbal > 5000 group by 1)
 select c_custkey, c_nationkey as nation, coalesce(c, 0) as candidates, case when c = 1 then k end as s_suppkey from customer left join n on c_nationkey = s_nationkey""")
def resolve_unique_candidate(spark, sf_dir):
    customer, supplier = read(spark, sf_dir, "customer", "supplier")
    rich = supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return resolve.unique_candidate_join(customer.select("c_custkey", F.col("c_nationkey").alias("nation")), rich, ["nation"], ["s_suppkey"])


@query("""with a as (select p_brand, p_type, p_size, min(p_partkey) t from part where p_retailprice < 1000 group by 1, 2, 3 having count(distinct p_partkey) = 1),
 b as (select p_brand, p_type, min(p_partkey) t from part where p_retailprice < 950 group by 1, 2 having count(distinct p_partkey) = 1)
 select p.p_partkey as part, coalesce(a.t, b.t) as p_partkey, case when a.t is not null then 'exact' when b.t is not null then 'family' else 'unresolved' end as basis
 from part p left join a using (p_brand, p_type, p_size) left join b using (p_brand, p_type)""")
def resolve_staged(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    stages = [("exact", part.where("p_retailprice < 1000"), ["p_brand", "p_type", "p_size"]), ("family", part.where("p_retailprice < 950"), ["p_brand", "p_type"])]
    left = part.select(F.col("p_partkey").alias("part"), "p_brand", "p_type", "p_size")
    return resolve.staged_resolution(left, ["part"], stages, "p_partkey").select("part", "p_partkey", "basis")


@query(r"""with p as (select page_id, regexp_replace(url, '[?#].*$', '') as path from pages), parts as (select page_id, path, string_split(path, '/') s from p),
 steps as (select page_id, array_to_string(s[1:n], '/') as prefix from parts, unnest(range(1, len(s) + 1)) t(n)),
 owners as (select distinct '/' || lang as prefix, lang as owner from documents union select '/en', 'english'),
 hits as (select page_id, prefix, owner from steps join owners using (prefix)), best as (select page_id, max(length(prefix)) m from hits group by 1),
 f as (select h.page_id, count(distinct owner) n, min(owner) owner, min(prefix) prefix from hits h join best b on h.page_id = b.page_id and length(prefix) = m group by 1)
 select p.page_id, prefix, case when n = 1 then owner end as owner, case when n is null then 'none' when n > 1 then 'ambiguous' else 'resolved' end as matched from p left join f using (page_id)""")
def resolve_longest_prefix(spark, sf_dir):
    pages, docs = read(spark, sf_dir, "pages", "documents")
    owners = docs.select(F.concat(F.lit("/"), "lang").alias("prefix"), F.col("lang").alias("owner")).distinct().unionByName(spark.createDataFrame([("/en", "english")], "prefix string, owner string"))
    left = pages.select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    return resolve.longest_prefix_join(left, ["page_id"], "path", owners, "prefix", "owner").select("page_id", "prefix", "owner", "matched")


@query(r"""select shape, count(*) as pages from (select '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> ''),
 lambda x: case when regexp_matches(x, '^[0-9]+(\.html)?$') then '{}' else x end), '/') as shape from pages) group by 1""")
def resolve_route_shapes(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    marked = F.regexp_replace("url", r"/\d+(\.html)?(?=$|[/?#])", "/{id}")
    return pages.groupBy(resolve.route_shape(marked).alias("shape")).agg(F.count("*").alias("pages"))


@query("""with s as (select doc_id, source from documents), t as (select distinct source, lang from documents)
 select d.doc_id, count(*) as hits from (select doc_id, source, lang || '.' || source || '.example' as host from documents) d
 join (select '*.' || source || '.example' as pattern from t group by 1 union all select lang || '.src1.example' from t where source = 'src1') p
 on d.host = p.pattern or (p.pattern like '*.%' and ends_with(d.host, substr(p.pattern, 2))) group by 1""")
def resolve_wildcard_hosts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    patterns = docs.select(F.concat(F.lit("*."), "source", F.lit(".example")).alias("pattern")).distinct().unionByName(docs.where("source = 'src1'").select(F.concat("lang", F.lit(".src1.example")).alias("pattern")).distinct())
    hosts = docs.select("doc_id", F.concat("lang", F.lit("."), "source", F.lit(".example")).alias("host"))
    return resolve.wildcard_host_join(hosts, "host", patterns, "pattern").groupBy("doc_id").agg(F.count("*").alias("hits"))


# Validation

@query("""select 'line-duplicate' as rule, l_orderkey || '/' || l_linenumber as subject, count(*) || ' rows' as detail from lineitem group by l_orderkey, l_linenumber having count(*) > 1
 union all select 'line-orphan', l_orderkey::varchar, count(*) || ' references' from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P') group by l_orderkey
 union all select 'customer-in-debt', c_custkey::varchar, c_mktsegment from customer where not coalesce(c_acctbal >= 0, false)""")
def validate_tables(spark, sf_dir):
    li, orders, customer = read(spark, sf_dir, "lineitem", "orders", "customer")
    return validate.violations(
        validate.duplicates(li, ["l_orderkey", "l_linenumber"], "line-duplicate"),
        validate.orphans(li, "l_orderkey", orders.where("o_orderstatus <> 'P'"), "o_orderkey", "line-orphan"),
        validate.failing(customer, F.col("c_acctbal") >= 0, "customer-in-debt", F.col("c_custkey"), F.col("c_mktsegment")),
    )


# Graph

@query(f"""with b as (select source, target, count(*) as edges, array_to_string(list_sort(list_distinct(list(label))), '+') as labels,
 case max(case status when 'verified' then 0 when 'declared' then 1 else 2 end) when 0 then 'verified' when 1 then 'declared' else 'unresolved' end as status from {TRADE} where source <> target group by 1, 2)
 select b.*, c.source is not null as back from b left join b c on b.source = c.target and b.target = c.source""")
def graph_bundles(spark, sf_dir):
    return graph.bundles(trade(spark, sf_dir), "source", "target", "status", "label").withColumn("labels", F.array_join("labels", "+"))


@query("""with pub as (select distinct l_partkey as event, l_suppkey as service from lineitem), con as (select distinct p_partkey as event, p_size * 20 as service from part),
 p as (select service, count(*) publishes from pub group by 1), c as (select service, count(distinct event) consumes from con group by 1)
 select coalesce(p.service, c.service) as service, s_nationkey as context, s_suppkey is null as ghost, coalesce(publishes, 0) as publishes, coalesce(consumes, 0) as consumes
 from p full join c on p.service = c.service left join supplier on s_suppkey = coalesce(p.service, c.service)""")
def graph_event_nodes(spark, sf_dir):
    li, part, supplier = read(spark, sf_dir, "lineitem", "part", "supplier")
    pub = li.select(F.col("l_partkey").alias("event"), F.col("l_suppkey").alias("service")).distinct()
    con = part.select(F.col("p_partkey").alias("event"), (F.col("p_size") * 20).cast("long").alias("service"), F.lit("declared").alias("status")).distinct()
    return graph.event_graph(pub, con, supplier.select(F.col("s_suppkey").alias("service"), F.col("s_nationkey").alias("context")))[0]


@query(f"""with l as (select a.n_regionkey as u, b.n_regionkey as d, count(*) n from {TRADE} t join nation a on source = a.n_nationkey join nation b on target = b.n_nationkey where a.n_regionkey <> b.n_regionkey and status = 'unresolved' and label = '1-URGENT' group by 1, 2),
 p as (select a.r_regionkey as x, b.r_regionkey as y from region a join region b on a.r_regionkey < b.r_regionkey)
 select x as "left", y as "right", coalesce(m.n, 0) as to_right, coalesce(o.n, 0) as to_left, coalesce(m.n, 0) + coalesce(o.n, 0) as weight,
 case when m.n is null and o.n is null then 'separate-ways' when m.n is not null and o.n is not null then 'partnership' else 'customer-supplier' end as pattern
 from p left join l m on m.u = x and m.d = y left join l o on o.u = y and o.d = x""")
def graph_context_map(spark, sf_dir):
    nation, region = read(spark, sf_dir, "nation", "region")
    up = nation.select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("upstream"))
    down = nation.select(F.col("n_nationkey").alias("target"), F.col("n_regionkey").alias("downstream"))
    links = trade(spark, sf_dir).where("status = 'unresolved' and label = '1-URGENT'").join(up, "source").join(down, "target")
    return graph.context_map(region.select(F.col("r_regionkey").alias("context"), F.col("r_regionkey").alias("place")), links, "place")


def _derived(spark, sf_dir) -> DataFrame:
    """A lineage over all parts: each is derived from the one at half its place, every third also from the one at a third."""
    part = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.where("p_partkey > 1").select(F.floor(k / 2).alias("source"), k.alias("target")).unionByName(part.where("p_partkey % 3 = 0 and p_partkey > 0").select(F.floor(k / 3).alias("source"), k.alias("target")))


DERIVED = "(select p_partkey // 2 as source, p_partkey as target from part where p_partkey > 1 union all select p_partkey // 3, p_partkey from part where p_partkey % 3 = 0 and p_partkey > 0)"


@query(f"""with recursive e as (select distinct source, target from {DERIVED}), r(root, node, depth) as (select target, source, 1 from e union select root, source, depth + 1 from r join e on node = target)
 select root, node, min(depth) as depth from r group by 1, 2""")
def graph_upstream_closure(spark, sf_dir):
    return graph.closure(_derived(spark, sf_dir), "target", "source")


@query(f"""with recursive e as (select distinct source, target from {DERIVED}), d(node, depth) as (select target, 1 from e where source = 3 union select target, depth + 1 from d join e on node = source),
 u(node, depth) as (select source, 1 from e where target = 3 union select source, depth + 1 from u join e on node = target)
 select node, 'downstream' as direction, min(depth) as depth from d group by 1 union all select node, 'upstream', min(depth) from u group by 1""")
def graph_lineage_chain(spark, sf_dir):
    return graph.lineage_chain(_derived(spark, sf_dir), "source", "target", 3)


def _busiest(spark, sf_dir) -> DataFrame:
    """Betweenness over pairs of nations that trade more than the mean of all pairs."""
    counts = trade(spark, sf_dir).where("source <> target").groupBy("source", "target").count()
    least = 1.2 * (counts.agg(F.avg("count")).first()[0] or 0.0)
    return graph.betweenness(graph.undirected(counts.where(F.col("count") > least), "source", "target"))


#: By definition: for each pair of other nodes, the share of shortest paths between them that pass; paths are counted one by one.
BETWEENNESS = f"""with recursive c as materialized (select source, target, count(*) as n from {TRADE} where source <> target group by 1, 2), b as materialized (select source, target from c where n > 1.2 * (select avg(n) from c)),
 e as materialized (select source as a, target as b from b union select target, source from b), w(s, v, d) as (select a, a, 0 from e union select s, e.b, d + 1 from w join e on v = a where d < 30), m as materialized (select s, v, min(d) as d from w group by 1, 2),
 p(s, v, d) as (select distinct a, a, 0 from e union all select p.s, e.b, p.d + 1 from p join e on p.v = e.a join m on m.s = p.s and m.v = e.b and m.d = p.d + 1), g as materialized (select s, v, d, count(*) as n from p group by 1, 2, 3),
 t as (select x.v, sum(x.n * y.n / z.n) as dep from g x join g y on x.v = y.s join g z on z.s = x.s and z.v = y.v and z.d = x.d + y.d where x.s <> x.v and y.v <> x.v and x.s <> y.v group by 1), k as (select count(distinct a) as k from e),
 f as (select distinct a as node, coalesce(dep, 0) / ((k - 1) * (k - 2)) as betweenness from e left join t on v = a cross join k)"""


@query(BETWEENNESS + " select node, round(betweenness, 6) as betweenness from f")
def graph_betweenness(spark, sf_dir):
    return _busiest(spark, sf_dir).withColumn("betweenness", F.round("betweenness", 6))


@query(BETWEENNESS + " select node, round(betweenness / sum(betweenness) over (), 6) as share from f where betweenness > 0")
def graph_bridges(spark, sf_dir):
    return graph.bridges(_busiest(spark, sf_dir)).select("node", F.round("share", 6).alias("share"))


@query("""with r as (select user_id, event_id, event_type from events where event_type in ('signup', 'error')), p as (select user_id, event_id, event_type from events where event_type in ('purchase', 'click'))
 select r.user_id, r.event_id, r.event_type as received, p.event_type as published, min(p.event_id) as published_event_id from r join p on r.user_id = p.user_id and p.event_id > r.event_id group by 1, 2, 3, 4""")
def graph_published_after(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnRenamed("event_type", "event")
    return graph.published_after(e.where("event in ('signup', 'error')"), e.where("event in ('purchase', 'click')"), ["user_id"], "event_id")


@query("""select distinct * from (select 'n' || n_nationkey as source, 'lies-in' as relation, 'r' || n_regionkey as target from nation union all select 'r' || n_regionkey, 'holds', 'n' || n_nationkey from nation
 union all select 'c' || c_custkey, 'lives-in', 'n' || c_nationkey from customer union all select 'n' || c_nationkey, 'houses', 'c' || c_custkey from customer)""")
def graph_related(spark, sf_dir):
    nation, customer = read(spark, sf_dir, "nation", "customer")
    n = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    c = customer.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    return graph.related((n, "a", "b", "lies-in", "holds"), (c, "a", "b", "lives-in", "houses"))


# Tables

@query("""select l_returnflag, case when bool_or(l_linestatus = 'O' and l_tax > 0.079) then 'open' else 'shut' end as state from lineitem group by 1""")
def rollup_any(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.when(F.bool_or((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.079)), "open").otherwise("shut").alias("state"))


@query("""select l_orderkey, case when bool_or(l_returnflag = 'R') then 'unresolved' when coalesce(bool_and(l_returnflag = 'N') filter (l_linestatus = 'O'), false) then 'verified' else 'declared' end as health from lineitem group by 1""")
def rollup_flow_health(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "unresolved").when(F.col("l_returnflag") == "N", "verified").otherwise("declared")
    return tables.health(li.withColumn("status", status), ["l_orderkey"], "status", F.col("l_linestatus") == "O")


@query("select o_custkey, count(*) filter (o_orderstatus = 'O') as O, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'P') as P from orders group by 1")
def rollup_status_counts(spark, sf_dir):
    return tables.status_counts(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["O", "F", "P"])


@query("""select user_id, case arg_min(event_type, event_id) when 'signup' then 'initiates' when 'error' then 'reacts' else 'participates' end as role from events group by 1""")
def rollup_flow_roles(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"))
    return e.select("user_id", F.when(F.col("first") == "signup", "initiates").when(F.col("first") == "error", "reacts").otherwise("participates").alias("role"))


@query("""select n_regionkey as context, count(distinct n_nationkey) as services, count(distinct c_custkey) as aggregates, count(*) filter (c_acctbal < 0) as unresolved from nation left join customer on c_nationkey = n_nationkey group by 1""")
def rollup_context_stats(spark, sf_dir):
    nation, customer = read(spark, sf_dir, "nation", "customer")
    j = nation.join(customer, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return j.groupBy(F.col("n_regionkey").alias("context")).agg(F.count_distinct("n_nationkey").alias("services"), F.count_distinct("c_custkey").alias("aggregates"), F.count_if(F.col("c_acctbal") < 0).alias("unresolved"))


@query("select facet, value, count(*) as rows from (select 'l_returnflag' as facet, l_returnflag as value from lineitem union all select 'l_linestatus', l_linestatus from lineitem union all select 'l_linenumber', l_linenumber::varchar from lineitem) group by 1, 2")
def table_facets(spark, sf_dir):
    return tables.facets(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(r"""with cells as (select unnest([{'column': 'size', 'v': p_size::varchar}, {'column': 'name', 'v': p_name}, {'column': 'release', 'v': 'v' || p_size || '.' || p_partkey}, {'column': 'candidate', 'v': 'v1.' || p_size || '.0-rc.1'},
  {'column': 'major', 'v': 'v' || p_size}, {'column': 'day', 'v': '2024-02-' || lpad((1 + p_size % 28)::varchar, 2, '0')}, {'column': 'nearly', 'v': '2024-02-' || lpad((1 + p_size % 31)::varchar, 2, '0')}, {'column': 'moment', 'v': '2024-02-03T10:00:00Z'},
  {'column': 'price', 'v': p_retailprice::varchar}, {'column': 'blank', 'v': ' '}], recursive := true) from part), t as (select "column", trim(v) as v from cells),
 kinds as (select "column", count(*) filter (v <> '') as n, bool_and(regexp_matches(v, '^-?[0-9]+([.][0-9]+)?$')) filter (v <> '') as num, bool_and(regexp_matches(v, '^v?[0-9]+([.][0-9]+)*$')) filter (v <> '') as ver,
  bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})?)?$') and try_cast(v[1:10] as date) is not null) filter (v <> '') as d from t group by 1)
 select "column", case when n = 0 then 'text' when num then 'number' when ver then 'version' when d then 'date' else 'text' end as type from kinds""")
def table_infer_types(spark, sf_dir):
    part, day = read(spark, sf_dir, "part"), lambda n: F.concat(F.lit("2024-02-"), F.lpad((1 + F.col("p_size") % n).cast("string"), 2, "0"))
    cells = part.select(F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.concat(F.lit("v"), "p_size", F.lit("."), "p_partkey").alias("release"), F.concat(F.lit("v1."), "p_size", F.lit(".0-rc.1")).alias("candidate"), F.concat(F.lit("v"), "p_size").alias("major"),
        day(28).alias("day"), day(31).alias("nearly"), F.lit("2024-02-03T10:00:00Z").alias("moment"), F.col("p_retailprice").alias("price"), F.lit(" ").alias("blank"))
    return tables.infer_types(cells, cells.columns)


@query("""select p_partkey, row_number() over (order by p_size // 10, p_size % 10, case when p_partkey % 2 = 0 then 0 else 1 end, p_partkey) as place from part""")
def table_version_sort(spark, sf_dir):
    v = F.concat(F.floor(F.col("p_size") / 10), F.lit("."), F.col("p_size") % 10, F.when(F.col("p_partkey") % 2 == 0, "-rc.1").otherwise(""))
    return tables.numbered(read(spark, sf_dir, "part").select("p_partkey", v.alias("v")), [tables.version_key(F.col("v")), F.col("p_partkey")]).drop("v")


@query("""select o_orderpriority, coalesce(string_agg(distinct o_orderstatus, '+' order by o_orderstatus) filter (c_mktsegment = 'BUILDING'), '') as BUILDING,
 coalesce(string_agg(distinct o_orderstatus, '+' order by o_orderstatus) filter (c_mktsegment = 'MACHINERY'), '') as MACHINERY from orders join customer on o_custkey = c_custkey group by 1""")
def table_access_matrix(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders", "customer")
    return tables.access_matrix(orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), "o_orderpriority", "c_mktsegment", "o_orderstatus", ["BUILDING", "MACHINERY"])


@query("select c_custkey, c_nationkey, (row_number() over (partition by c_nationkey order by c_custkey) - 1) % 2 as stripe from customer")
def table_stripes(spark, sf_dir):
    return tables.stripes(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", ["c_custkey"])


@query("select * from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) where place <= 3")
def table_top_per_group(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).drop("o_totalprice")


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 8")
def table_widest(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(8)


@query("select event_type, value < 0 as severity, count(*) as rows, min(props) as example from events group by 1, 2")
def table_grouped_warnings(spark, sf_dir):
    return tables.grouped_warnings(read(spark, sf_dir, "events").withColumn("severity", F.col("value") < 0), ["event_type"], "severity", "props")


# Rules

RULES = [
    rules.Rule("deep-discount", "line", "discount_pct > 8 && quantity >= 40", '"order " + string(order_key) + " gives " + string(discount_pct) + "%"', "error"),
    rules.Rule("returned-open", "line", 'flag == "R" && status != "F"', '"returned " + flag', "warning"),
    rules.Rule("odd-mode", "line", 'flag in ["A", "R"] && !(status.startsWith("F")) || quantity % 50 == 49', '"odd"', "info", True, "too many"),
    rules.Rule("broken", "line", "no_such_field > 1"),
]


def _lines(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("order_key"), F.round(F.col("l_discount") * 100).cast("long").alias("discount_pct"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


LINES = "(select concat_ws('/', l_orderkey, l_linenumber, l_partkey) as id, l_orderkey as order_key, round(l_discount * 100)::bigint as discount_pct, trunc(l_quantity)::bigint as quantity, l_returnflag as flag, l_linestatus as status from lineitem)"


@query(f"""select 'deep-discount' as rule, 'error' as severity, false as disabled, id as subject, 'order ' || order_key || ' gives ' || discount_pct || '%' as message from {LINES} where discount_pct > 8 and quantity >= 40
 union all select 'returned-open', 'warning', false, id, 'returned ' || flag from {LINES} where flag = 'R' and status <> 'F'
 union all select 'odd-mode', 'info', true, id, 'odd' from {LINES} where flag in ('A', 'R') and not starts_with(status, 'F') or quantity % 50 = 49""")
def rule_problems(spark, sf_dir):
    return rules.evaluate(_lines(spark, sf_dir), "line", RULES, "id")[0]


@query(f"""select rule, disabled, count(*) as rows from (select 'deep-discount' as rule, false as disabled from {LINES} where discount_pct > 8 and quantity >= 40
 union all select 'returned-open', false from {LINES} where flag = 'R' and status <> 'F'
 union all select 'odd-mode', true from {LINES} where flag in ('A', 'R') and not starts_with(status, 'F') or quantity % 50 = 49) group by 1, 2""")
def rule_counts(spark, sf_dir):
    return rules.evaluate(_lines(spark, sf_dir), "line", RULES, "id")[0].groupBy("rule", "disabled").agg(F.count("*").alias("rows"))


@query("""with o as (select o_orderkey, o_orderstatus <> 'F' as s, starts_with(o_orderpriority, '1') as p, o_custkey % 7 = 3 as c, (o_orderstatus <> 'F') and (starts_with(o_orderpriority, '1') or o_custkey % 7 = 3) as m from orders),
 f as (select *, m <> (p or c) as ds, m <> (s and c) as dp, m <> (s and p) as dc from o)
 select o_orderkey, m as matched, 'status' as field, ds as decisive, m and not (ds or dp or dc) as joint from f union all select o_orderkey, m, 'priority', dp, m and not (ds or dp or dc) from f
 union all select o_orderkey, m, 'customer', dc, m and not (ds or dp or dc) from f""")
def rule_why(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    return rules.why(rows, 'status != "F" && (priority.startsWith("1") || customer % 7 == 3)', "o_orderkey").drop("items")


@query("""with t as (select o_custkey, list_sort(list_distinct(list(o_orderpriority))) as tags from orders group by 1), k as (select *, list_filter(tags, lambda x: starts_with(x, '1') or starts_with(x, '2')) as hit from t)
 select o_custkey, len(hit) > 0 as matched, len(hit) > 0 as decisive, case when len(tags) = 1 and len(hit) = 1 then tags[1] when len(hit) < len(tags) then array_to_string(hit, '+') else '' end as items from k""")
def rule_why_items(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("tags"))
    return rules.why(rows, 'tags.exists(t, t.startsWith("1") || t.startsWith("2"))', "o_custkey").select("o_custkey", "matched", "decisive", F.array_join("items", "+").alias("items"))


@query(f"""with c as (select n_regionkey as context, l_suppkey as service, o_custkey as peer, min(case l_returnflag when 'N' then 0 when 'A' then 1 else 2 end) as best
 from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2, 3)
 select 'rpc' as rule, context, count(*) as problems from c where best = 2 group by 2""")
def catalog_problems(spark, sf_dir):
    """Which edges of the estate are unresolved, by context: suppliers call customers, regions are contexts."""
    li, orders, supplier, nation = read(spark, sf_dir, "lineitem", "orders", "supplier", "nation")
    status = F.when(F.col("l_returnflag") == "R", "unresolved").when(F.col("l_returnflag") == "A", "declared").otherwise("verified")
    raw = li.join(orders, li.l_orderkey == orders.o_orderkey).join(supplier, li.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    raw = raw.select(F.col("n_regionkey").alias("context"), F.col("l_suppkey").alias("service"), F.col("o_custkey").cast("string").alias("peer"), status.alias("status"), F.lit("").alias("note"), F.col("l_orderkey").alias("source"))
    calls = merge.raise_status(raw, ["context", "service", "peer"], "status", "note", ["source"])
    rows = calls.select(F.concat_ws("/", "context", "service", "peer").alias("id"), "peer", (F.col("status") != "unresolved").alias("resolved"), F.lit(True).alias("peerKnown"), F.lit(True).alias("methodDeclared"))
    found = rules.evaluate(rows, "call", [r for r in subjects.BUILTIN if r.over == "call"], "id")[0]
    return found.groupBy("rule", F.substring_index("subject", "/", 1).cast("int").alias("context")).agg(F.count("*").alias("problems"))


# Diff

def _sides(spark, sf_dir, cut: str):
    o = read(spark, sf_dir, "orders")
    one = lambda df: df.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("priority"))
    return one(o.where(F.col("o_orderdate") < cut)), one(o.where(F.col("o_orderdate") >= cut))


def _side_sql(test: str) -> str:
    return f"(select o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) as status, max_by(o_orderpriority, (o_orderdate, o_orderkey)) as priority from orders where o_orderdate {test} group by 1)"


A, B = _side_sql("< timestamp '1998-01-01'"), _side_sql(">= timestamp '1998-01-01'")


@query(f"""select 'customer' as entity, coalesce(a.o_custkey, b.o_custkey)::varchar as "where", 'removed' as kind, null::varchar as field, null::varchar as before, null::varchar as after, 'breaking' as severity from {A} a full join {B} b on a.o_custkey = b.o_custkey where b.o_custkey is null
 union all select 'customer', b.o_custkey::varchar, 'added', null, null, null, 'addition' from {A} a right join {B} b on a.o_custkey = b.o_custkey where a.o_custkey is null
 union all select 'customer', a.o_custkey::varchar, 'changed', 'status', a.status, b.status, case when b.status = 'P' then 'breaking' else 'change' end from {A} a join {B} b on a.o_custkey = b.o_custkey where a.status <> b.status
 union all select 'customer', a.o_custkey::varchar, 'changed', 'priority', a.priority, b.priority, 'change' from {A} a join {B} b on a.o_custkey = b.o_custkey where a.priority <> b.priority""")
def diff_snapshots(spark, sf_dir):
    before, after = _sides(spark, sf_dir, "1998-01-01")
    return diff.keyed_diff(before, after, ["o_custkey"], ["status", "priority"], "customer", changed={"status": F.when(F.col("after_status") == "P", "breaking").otherwise("change")})


@query(f"""with m as {_side_sql(">= timestamp '2000-01-01'")} select coalesce(a.o_custkey, b.o_custkey) as o_custkey,
 case when (a.status is distinct from m.status) and (b.status is distinct from m.status) then 'conflict' when a.o_custkey is null then 'added' when b.o_custkey is null then 'removed' else 'changed' end as state
 from {A} a full join {B} b on a.o_custkey = b.o_custkey left join m on m.o_custkey = coalesce(a.o_custkey, b.o_custkey) where a.status is distinct from b.status""")
def diff_against_main(spark, sf_dir):
    base, branch = _sides(spark, sf_dir, "1998-01-01")
    main = _sides(spark, sf_dir, "2000-01-01")[1]
    return diff.against_main(["o_custkey"], base, branch, main, "status")


@query("""select o_custkey, o_orderdate, o_orderkey, 'o_orderpriority' as field, was as before, o_orderpriority as after from (select *, lag(o_orderpriority) over (partition by o_custkey order by o_orderdate, o_orderkey) was from orders) where was <> o_orderpriority""")
def diff_versions(spark, sf_dir):
    return diff.version_changes(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderpriority"])


# Search

@query("""select * from (select 'part' as kind, p_partkey::varchar as id, p_name as name from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') order by 2 limit 50)""")
def search_catalog(spark, sf_dir):
    part, customer = read(spark, sf_dir, "part", "customer")
    found = search.resources((part, "part", "p_partkey", "p_name", ["p_name", "p_brand", "p_type"]), (customer, "customer", "c_custkey", "c_name", ["c_name", "c_mktsegment"]))
    return search.search(found, "part:Brand#1", ["part", "customer"])


@query("""select p_partkey, case when lower(p_name) = 'bolt' then 0 when contains(lower(p_name), 'bolt') then 1 when contains(lower(p_brand), 'bolt') then 2 else 3 end as rank from part where contains(lower(p_name), 'bolt') or contains(lower(p_brand), 'bolt') or contains(lower(p_type), 'bolt')""")
def search_ranked(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", search.match_rank("bolt", F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("rank")).where("rank is not null")


# Functions

@query(r"""select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') as slug, p_partkey || case when p_partkey = 1 then ' part' else ' parts' end as counted,
 case when length(p_name || p_type || p_brand) <= 16 then p_name || p_type || p_brand else substr(p_name || p_type || p_brand, 1, 8) || '…' || right(p_name || p_type || p_brand, 7) end as short from part""")
def text_functions(spark, sf_dir):
    long = F.concat("p_name", "p_type", "p_brand")
    return read(spark, sf_dir, "part").select("p_partkey", fn.slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"), fn.plural(F.col("p_partkey"), "part").alias("counted"), fn.middle_truncate(long, 16).alias("short"))


@query(r"""select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b([A-Z]{2,6})\b', 1))), '+') as abbreviations from documents""")
def text_abbreviations(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(fn.abbreviations(F.col("text")), "+").alias("abbreviations"))


# Traces

def _spans(spark, sf_dir) -> DataFrame:
    """Events as spans: a user's events of a day are a trace, and each event's parent is the one at half its place."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("trace_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")))
    w = Window.partitionBy("trace_id").orderBy("event_id")
    n = F.row_number().over(w).cast("long")
    return e.select("trace_id", n.alias("span_id"), F.when(n > 1, F.floor(n / 2)).cast("long").alias("parent_id"), F.col("event_id").alias("start"), F.col("event_type").alias("name"))


SPANS = "(select user_id || '-' || strftime(ts, '%Y%m%d') as trace_id, row_number() over (partition by user_id || '-' || strftime(ts, '%Y%m%d') order by event_id) as span_id, event_id as start, event_type as name from events)"


@query(f"""with recursive s as (select *, case when span_id > 1 then span_id // 2 end as parent_id from {SPANS}),
 t(trace_id, span_id, name, depth, path) as (select trace_id, span_id, name, 0, [(start, span_id)] from s where parent_id is null
 union all select s.trace_id, s.span_id, s.name, depth + 1, list_append(path, (s.start, s.span_id)) from s join t on s.trace_id = t.trace_id and s.parent_id = t.span_id)
 select trace_id, span_id, name, depth, row_number() over (partition by trace_id order by path) as ord from t""")
def trace_sequence(spark, sf_dir):
    return traces.sequence(_spans(spark, sf_dir)).select("trace_id", "span_id", "name", "depth", "ord")


@query(f"""select split_part(route, '>', 1) as opening, route, count(*) as traces, min(trace_id) as first_trace from (select trace_id, string_agg(name, '>' order by start) as route from {SPANS} group by 1) group by 1, 2""")
def trace_routes(spark, sf_dir):
    return traces.routes(_spans(spark, sf_dir), "trace_id", ["start"], "name").withColumn("route", F.array_join("route", ">"))


@query(f"""select split_part(route, '>', 1) as opening, route, count(*) as traces from (select trace_id, string_agg(name, '>' order by start) as route from {SPANS} group by 1) group by 1, 2""")
def trace_fold(spark, sf_dir):
    """The fold of all routes, laid out again: it must hold every route as often as it was shown."""
    folded = traces.fold(traces.routes(_spans(spark, sf_dir), "trace_id", ["start"], "name"))
    return traces.unfold(folded).withColumn("route", F.array_join("route", ">"))


@query(f"""select * from (select name, trace_id, spans, row_number() over (partition by name order by spans desc, start, trace_id) as place
 from (select trace_id, arg_min(name, start) as name, count(*) as spans, min(start) as start from {SPANS} group by 1)) where place <= 3""")
def trace_examples(spark, sf_dir):
    per = _spans(spark, sf_dir).groupBy("trace_id").agg(F.min_by("name", "start").alias("name"), F.count("*").alias("spans"), F.min("start").alias("start"))
    return traces.pick_examples(per, ["name"], "spans", "start", "trace_id").drop("start")


@query(f"""select step_id, count(distinct trace_id) as seen from {SPANS} join (values ('view', 's1'), ('purchase', 's2'), ('error', 's3')) v(name, step_id) using (name) group by 1""")
def trace_seen_steps(spark, sf_dir):
    steps = spark.createDataFrame([("view", "s1"), ("purchase", "s2"), ("error", "s3")], "name string, step_id string")
    return traces.seen_counts(traces.match_steps(_spans(spark, sf_dir), steps, "trace_id", "start", "name"), "trace_id")
