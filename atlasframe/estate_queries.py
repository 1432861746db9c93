"""Operators on the facts of an estate, bound to the relational test tables, each with the SQL that must give the same rows.

The tables play the estate's parts; what part a table plays is said by a small SELECT that both engines read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.operators import changes
from atlasframe.queries import query, read


def part(spark, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a SELECT over the test tables, which it names in braces."""
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))})


def sub(sql: str) -> str:
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"


# Differences of two catalogs: orders before 1998 and from 1998 on are the two sides.

OLD, NEW = "o_orderdate < timestamp '1998-01-01'", "o_orderdate >= timestamp '1998-01-01'"


def sides(sql: str) -> tuple[str, str]:
    return sql.replace("@side", OLD), sql.replace("@side", NEW)


def both(spark, sf_dir, pair: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    return part(spark, sf_dir, pair[0]), part(spark, sf_dir, pair[1])


def told(pair: tuple[str, str], key: str, where: str, *lines: tuple[str, str, str, str], parents: tuple[str, tuple[str, str]] | None = None, extra: str = "") -> str:
    """SQL of a family of changes: lines are (kind, severity, summary, condition) over ``a`` and ``b``, the rows of the two sides."""
    keys = [k.strip() for k in key.split(",")]
    on = " and ".join(f"a.{k} = b.{k}" for k in keys)
    ids = ", ".join(f"coalesce(a.{k}, b.{k}) as {k}" for k in keys)
    within = ""
    if parents:
        name, (x, y) = parents
        cols = [c.strip() for c in name.split(",")]
        same = " and ".join(f"x.{c} = y.{c}" for c in cols)
        within = f" where ({', '.join(f'j.k.{c}' for c in cols)}) in (select ({', '.join(f'x.{c}' for c in cols)}) from (select distinct {name} from {sub(x)}) x join (select distinct {name} from {sub(y)}) y on {same})" if len(cols) > 1 else (
            f" where j.k.{name} in (select x.{name} from {sub(x)} x join {sub(y)} y on x.{name} = y.{name})")
    base = f"select struct_pack({', '.join(f'{k} := {k}' for k in keys)}) as k, a, b {extra} from (select {ids}, a, b from (select *, true as _in from {sub(pair[0])}) a full join (select *, true as _in from {sub(pair[1])}) b on {on})"
    rows = f"with j as materialized (select * from ({base}) j{within})"
    parts = [f"select '{kind}' as kind, {severity} as severity, {where}::varchar as \"where\", {summary} as summary from j where {when}" for kind, severity, summary, when in lines]
    return rows + " " + " union all ".join(parts)


IS_NEW, IS_GONE, IN_BOTH = "a._in is null", "b._in is null", "a._in and b._in"
STATUS = "case o_orderstatus when 'F' then 'verified' when 'O' then 'declared' else 'unresolved' end"
DROP = "case when (case b.status when 'verified' then 2 when 'declared' then 1 else 0 end) < (case a.status when 'verified' then 2 when 'declared' then 1 else 0 end) then 'breaking' else 'change' end"

CONTEXTS = sides("select o_custkey as id, max_by(o_orderpriority, o_orderkey) as kind, nullif(max_by(o_orderstatus, o_orderkey), 'P') as classification from {orders} where @side group by o_custkey")


@query(told(CONTEXTS, "id", "k.id", ("context.added", "'addition'", "'context \"' || k.id || '\" is new'", IS_NEW), ("context.removed", "'breaking'", "'context \"' || k.id || '\" is gone'", IS_GONE),
    ("context.kind", "'change'", "'group \"' || k.id || '\" is a ' || b.kind || ', was ' || a.kind", f"{IN_BOTH} and a.kind <> b.kind"),
    ("context.classification", "'change'", "'context \"' || k.id || '\" is classified ' || coalesce(b.classification, 'nothing') || ', was ' || coalesce(a.classification, 'nothing')", f"{IN_BOTH} and a.classification is distinct from b.classification")))
def diff_contexts(spark, sf_dir):
    return changes.context_changes(*both(spark, sf_dir, CONTEXTS))


SERVICES = sides("select o_custkey as id, max_by(o_orderpriority, o_orderkey) as kind, max_by(o_orderstatus, o_orderkey) as context from {orders} where @side group by o_custkey")


@query(told(SERVICES, "id", "k.id", ("service.added", "'addition'", "'service \"' || k.id || '\" is new'", IS_NEW), ("service.removed", "'breaking'", "'service \"' || k.id || '\" is gone'", IS_GONE),
    ("service.kind", "'change'", "'component \"' || k.id || '\" is a ' || b.kind || ', was ' || a.kind", f"{IN_BOTH} and a.kind <> b.kind"), ("service.moved", "'change'", "'service \"' || k.id || '\" moved from ' || a.context || ' to ' || b.context", f"{IN_BOTH} and a.context <> b.context")))
def diff_services(spark, sf_dir):
    return changes.service_changes(*both(spark, sf_dir, SERVICES))


OWNED = sides("select distinct o_custkey as id, o_orderpriority as value from {orders} where @side and o_orderstatus <> 'P'")
KNOWN = sides("select distinct o_custkey as id from {orders} where @side")


@query(told(OWNED, "id, value", "k.id", ("owner.added", "'change'", "k.value || ' now owns \"' || k.id || '\"'", IS_NEW),
    ("owner.removed", f"case when k.id in (select id from {sub(OWNED[1])}) then 'change' else 'breaking' end", "k.value || ' no longer owns \"' || k.id || '\"'", IS_GONE), parents=("id", KNOWN)))
def diff_owners(spark, sf_dir):
    return changes.set_changes(*both(spark, sf_dir, OWNED), both(spark, sf_dir, KNOWN), "owner", '{value} now owns "{id}"', '{value} no longer owns "{id}"', "breaking")


@query(told(OWNED, "id, value", "k.id", ("technology.added", "'change'", "'\"' || k.id || '\" now uses ' || k.value", IS_NEW), ("technology.removed", "'change'", "'\"' || k.id || '\" no longer uses ' || k.value", IS_GONE), parents=("id", KNOWN)))
def diff_technologies(spark, sf_dir):
    return changes.set_changes(*both(spark, sf_dir, OWNED), both(spark, sf_dir, KNOWN), "technology", '"{id}" now uses {value}', '"{id}" no longer uses {value}')


INTERFACES = sides("select distinct o_custkey as service, o_orderpriority as interface from {orders} where @side")
CUSTOMERS = sides("select distinct o_custkey as service from {orders} where @side")


@query(told(INTERFACES, "service, interface", "k.service", ("interface.added", "'addition'", "'\"' || k.service || '\" provides ' || k.interface", IS_NEW), ("interface.removed", "'breaking'", "'\"' || k.service || '\" no longer provides ' || k.interface", IS_GONE), parents=("service", CUSTOMERS)))
def diff_interfaces(spark, sf_dir):
    return changes.interface_changes(*both(spark, sf_dir, INTERFACES), both(spark, sf_dir, CUSTOMERS))


METHODS = sides("""select o_custkey as service, o_orderpriority as interface, o_orderstatus as name, nullif(max_by(case when o_totalprice > 200000 then 'Big' else '' end, o_orderkey), '') as request, cast(count(*) as varchar(9)) as response,
 max_by(case when o_totalprice > 300000 then 'server' else '' end, o_orderkey) as streaming, case when count(*) > 1 then 'GET' end as http_method, case when count(*) > 2 then '/orders' end as http_path, cast(null as varchar(9)) as soap, max(o_totalprice) > 400000 as deprecated
 from {orders} where @side group by o_custkey, o_orderpriority, o_orderstatus""")


def _signature(m: str) -> str:
    return f"concat_ws(' → ', coalesce({m}.request, '?'), coalesce({m}.response, '?'), nullif({m}.streaming, ''), case when {m}.http_path is not null then coalesce({m}.http_method, '?') || ' ' || {m}.http_path end, {m}.soap)"


@query(told(METHODS, "service, interface, name", "k.service", ("method.added", "'addition'", "k.interface || ' gained ' || k.name", IS_NEW), ("method.removed", "'breaking'", "k.interface || ' lost ' || k.name", IS_GONE),
    ("method.signature", "'breaking'", f"k.interface || '/' || k.name || ' is now ' || {_signature('b')} || ', was ' || {_signature('a')}", f"{IN_BOTH} and {_signature('a')} <> {_signature('b')}"),
    ("method.deprecated", "'change'", "k.interface || '/' || k.name || ' is deprecated'", f"{IN_BOTH} and not a.deprecated and b.deprecated"), parents=("service, interface", METHODS)))
def diff_methods(spark, sf_dir):
    return changes.method_changes(*both(spark, sf_dir, METHODS))


CALLS = sides(f"select o_custkey as service, o_orderpriority as id, max_by({STATUS}, o_orderkey) as status from {{orders}} where @side group by o_custkey, o_orderpriority")


@query(told(CALLS, "service, id", "k.service", ("call.added", "'addition'", "'\"' || k.service || '\" now calls ' || k.id", IS_NEW), ("call.removed", "'change'", "'\"' || k.service || '\" no longer calls ' || k.id", IS_GONE),
    ("call.status", DROP, "'\"' || k.service || '\" → ' || k.id || ' is ' || b.status || ', was ' || a.status", f"{IN_BOTH} and a.status <> b.status"), parents=("service", CUSTOMERS)))
def diff_calls(spark, sf_dir):
    return changes.call_changes(*both(spark, sf_dir, CALLS), both(spark, sf_dir, CUSTOMERS))


CHANNELS = sides("select distinct o_custkey as service, o_orderpriority as address from {orders} where @side")


@query(told(CHANNELS, "service, address", "k.service", ("channel.added", "'addition'", "'\"' || k.service || '\" declares channel ' || k.address", IS_NEW), ("channel.removed", "'breaking'", "'\"' || k.service || '\" no longer declares channel ' || k.address", IS_GONE), parents=("service", CUSTOMERS)))
def diff_channels(spark, sf_dir):
    return changes.channel_changes(*both(spark, sf_dir, CHANNELS), both(spark, sf_dir, CUSTOMERS))


MESSAGES = sides("select o_custkey as service, o_orderpriority as address, 'send' as direction, o_orderstatus as name, nullif(max_by(case when o_totalprice > 250000 then 'avro' when o_totalprice > 100000 then 'json' else '' end, o_orderkey), '') as encoding from {orders} where @side group by o_custkey, o_orderpriority, o_orderstatus")


@query(told(MESSAGES, "service, address, direction, name", "k.service", ("message.encoding", "case when a.encoding is not null and b.encoding is not null then 'breaking' else 'change' end",
    "k.direction || ' message ' || k.name || ' on ' || k.address || ' uses ' || coalesce(b.encoding, 'an unspecified encoding') || ', was ' || coalesce(a.encoding, 'unspecified')", f"{IN_BOTH} and a.encoding is distinct from b.encoding")))
def diff_encodings(spark, sf_dir):
    return changes.encoding_changes(*both(spark, sf_dir, MESSAGES))


ENTITIES = sides("select distinct o_custkey as id from {orders} where @side")
PARTS = sides("select distinct o_custkey as owner, o_orderpriority as id from {orders} where @side")


@query(told(ENTITIES, "id", "k.id", ("aggregate.added", "'addition'", "'aggregate \"' || k.id || '\" is new'", IS_NEW), ("aggregate.removed", "'breaking'", "'aggregate \"' || k.id || '\" is gone'", IS_GONE)) + " union all "
    + told(PARTS, "owner, id", "k.owner", ("operation.added", "'addition'", "k.id || ' is new'", IS_NEW), ("operation.removed", "'breaking'", "k.id || ' is gone'", IS_GONE), parents=("owner", PARTS)).replace("with j as", "select * from (with j as", 1) + ")")
def diff_aggregates(spark, sf_dir):
    whole = changes.entity_changes(*both(spark, sf_dir, ENTITIES), "aggregate", 'aggregate "{id}" is new', 'aggregate "{id}" is gone', "breaking")
    return whole.unionByName(changes.part_changes(*both(spark, sf_dir, PARTS), "operation", "{id} is new", "{id} is gone", "breaking"))


EVENTS = sides("select o_custkey as aggregate, o_orderpriority as id, cast(count(*) filter (where o_orderstatus <> 'P') as bigint) as consumers from {orders} where @side group by o_custkey, o_orderpriority")


@query(told(EVENTS, "aggregate, id", "k.id", ("event.added", "'addition'", "case when b.consumers = 0 then k.id || ' is published, and nothing consumes it' else k.id || ' is published, consumed by ' || b.consumers end", IS_NEW),
    ("event.removed", "'breaking'", "case when a.consumers = 0 then k.id || ' is gone' else k.id || ' is gone, and ' || a.consumers || ' consumed it' end", IS_GONE), parents=("aggregate", EVENTS)))
def diff_events(spark, sf_dir):
    return changes.event_changes(*both(spark, sf_dir, EVENTS))


CONSUMERS = sides(f"select o_custkey as event, o_orderpriority as consumer, max_by({STATUS}, o_orderkey) as status from {{orders}} where @side group by o_custkey, o_orderpriority")
EVENT_IDS = sides("select distinct o_custkey as event from {orders} where @side")


@query(told(CONSUMERS, "event, consumer", "k.event", ("consumer.added", "'addition'", "k.consumer || ' consumes ' || k.event", IS_NEW), ("consumer.removed", "'change'", "k.consumer || ' no longer consumes ' || k.event", IS_GONE),
    ("consumer.status", DROP, "k.consumer || ' consuming ' || k.event || ' is ' || b.status || ', was ' || a.status", f"{IN_BOTH} and a.status <> b.status"), parents=("event", EVENT_IDS)))
def diff_consumers(spark, sf_dir):
    return changes.consumer_changes(*both(spark, sf_dir, CONSUMERS), both(spark, sf_dir, EVENT_IDS))


MOVES = sides("select distinct o_custkey as owner, o_orderstatus || ' --' || o_orderpriority || '--> ' || o_orderstatus as id from {orders} where @side")


@query(told(MOVES, "owner, id", "k.owner", ("transition.added", "'addition'", "'\"' || k.owner || '\": ' || k.id", IS_NEW), ("transition.removed", "'breaking'", "'\"' || k.owner || '\" no longer: ' || k.id", IS_GONE), parents=("owner", MOVES)))
def diff_lifecycles(spark, sf_dir):
    return changes.part_changes(*both(spark, sf_dir, MOVES), "transition", '"{owner}": {id}', '"{owner}" no longer: {id}', "breaking")


STORES = sides("select o_custkey as id, max_by(o_orderpriority, o_orderkey) as owner from {orders} where @side group by o_custkey")


@query(told(STORES, "id", "k.id", ("store.added", "'addition'", "'store \"' || k.id || '\" is new'", IS_NEW), ("store.removed", "'breaking'", "'store \"' || k.id || '\" is gone'", IS_GONE),
    ("store.owner", "'breaking'", "'store \"' || k.id || '\" is owned by ' || b.owner || ', was ' || a.owner", f"{IN_BOTH} and a.owner <> b.owner")) + " union all "
    + told(PARTS, "owner, id", "k.owner", ("table.added", "'addition'", "k.owner || '.' || k.id || ' is new'", IS_NEW), ("table.removed", "'breaking'", "k.owner || '.' || k.id || ' is gone'", IS_GONE), parents=("owner", PARTS)).replace("with j as", "select * from (with j as", 1) + ")")
def diff_stores(spark, sf_dir):
    return changes.store_changes(*both(spark, sf_dir, STORES)).unionByName(changes.part_changes(*both(spark, sf_dir, PARTS), "table", "{owner}.{id} is new", "{owner}.{id} is gone", "breaking"))


PINS = sides("select o_custkey as id, nullif(max_by(o_orderpriority || o_orderstatus, o_orderkey), '5-LOWP') as commit from {orders} where @side group by o_custkey")
SHORT = "coalesce(substr({0}.commit, 1, 7), 'nothing')"


@query(told(PINS, "id", "k.id", ("module.added", "'addition'", "'module \"' || k.id || '\" is new'", IS_NEW), ("module.removed", "'breaking'", "'module \"' || k.id || '\" is gone'", IS_GONE),
    ("module.commit", "'change'", f"'module \"' || k.id || '\" is at ' || {SHORT.format('b')} || ', was ' || {SHORT.format('a')}", f"{IN_BOTH} and a.commit is distinct from b.commit")))
def diff_modules(spark, sf_dir):
    return changes.pin_changes(*both(spark, sf_dir, PINS), "module")


@query(told(PINS, "id", "k.id", ("repo.added", "'addition'", f"k.id || ' is vendored at ' || {SHORT.format('b')}", IS_NEW), ("repo.removed", "'change'", "k.id || ' is no longer vendored'", IS_GONE),
    ("repo.commit", "'change'", f"k.id || ' moved from ' || {SHORT.format('a')} || ' to ' || {SHORT.format('b')}", f"{IN_BOTH} and a.commit is distinct from b.commit")))
def diff_repos(spark, sf_dir):
    return changes.pin_changes(*both(spark, sf_dir, PINS), "repo")


STEPS = sides(f"select o_custkey as flow, 'f' || o_custkey as slug, o_orderpriority as id, 'a → b ' || o_orderpriority as text, max_by({STATUS}, o_orderkey) as status from {{orders}} where @side group by o_custkey, o_orderpriority")


@query(told(STEPS, "flow, id", "k.flow", ("step.added", "'addition'", "b.slug || ' gained ' || b.text", IS_NEW), ("step.removed", "'change'", "a.slug || ' lost ' || a.text", IS_GONE),
    ("step.status", DROP, "a.slug || ' step ' || k.id || ' is ' || b.status || ', was ' || a.status", f"{IN_BOTH} and a.status <> b.status"), parents=("flow", STEPS)))
def diff_steps(spark, sf_dir):
    return changes.step_changes(*both(spark, sf_dir, STEPS))


DECISIONS = sides("select o_custkey as id, 'order ' || max(o_orderkey) as title, max_by(case o_orderstatus when 'F' then 'accepted' when 'O' then 'proposed' else 'superseded' end, o_orderkey) as status, nullif(max_by(case when o_orderstatus = 'P' then o_orderpriority else '' end, o_orderkey), '') as superseded_by, max_by(o_orderpriority, o_orderkey) as body from {orders} where @side group by o_custkey")


@query(told(DECISIONS, "id", "k.id", ("adr.added", "'addition'", "k.id || ' — ' || b.title", IS_NEW), ("adr.removed", "'change'", "k.id || ' is gone'", IS_GONE), ("adr.status", "'change'", "k.id || ' is ' || b.status || ', was ' || a.status", f"{IN_BOTH} and a.status <> b.status"),
    ("adr.superseded", "'change'", "k.id || ' is superseded by ' || b.superseded_by", f"{IN_BOTH} and a.superseded_by is distinct from b.superseded_by and b.superseded_by <> ''"),
    ("adr.body", "'change'", "k.id || ' was edited after being ' || a.status", f"{IN_BOTH} and a.body <> b.body and a.status in ('accepted', 'superseded')")))
def diff_decisions(spark, sf_dir):
    return changes.decision_changes(*both(spark, sf_dir, DECISIONS))


PROPOSALS = sides("select o_custkey as id, 'RFC-' || o_custkey as display, 'order ' || max(o_orderkey) as title, max_by(o_orderpriority, o_orderkey) as status, max_by(case o_orderstatus when 'F' then 'accepted' when 'O' then 'draft' else 'rejected' end, o_orderkey) as lifecycle, nullif(max_by(case when o_totalprice > 200000 then 'big' else '' end, o_orderkey), '') as repository, max_by(o_orderstatus, o_orderkey) as body from {orders} where @side group by o_custkey")


@query(told(PROPOSALS, "id", "k.id", ("rfc.added", "'addition'", "b.display || ' — ' || b.title", IS_NEW), ("rfc.removed", "'change'", "a.display || ' is gone'", IS_GONE),
    ("rfc.status", "'change'", "b.display || ' is ' || b.status || ', was ' || a.status || case when a.lifecycle <> b.lifecycle then ' (' || b.lifecycle || ', was ' || a.lifecycle || ')' else '' end", f"{IN_BOTH} and (a.status <> b.status or a.lifecycle <> b.lifecycle)"),
    ("rfc.repository", "'change'", "b.display || ' moved from ' || coalesce(a.repository, 'the catalog repository') || ' to ' || coalesce(b.repository, 'the catalog repository')", f"{IN_BOTH} and a.repository is distinct from b.repository"),
    ("rfc.body", "'change'", "b.display || ' was edited after being ' || a.lifecycle", f"{IN_BOTH} and a.body <> b.body and a.lifecycle in ('accepted', 'rejected')")))
def diff_proposals(spark, sf_dir):
    return changes.proposal_changes(*both(spark, sf_dir, PROPOSALS))


REQUIREMENTS = sides("select o_custkey as spec, o_orderpriority as id, max_by(o_orderstatus, o_orderkey) as title, cast(count(*) as varchar(9)) as text from {orders} where @side group by o_custkey, o_orderpriority")
SCENARIOS = sides("select 'r' || o_custkey as requirement, o_orderpriority as name, cast(count(*) as varchar(9)) as steps from {orders} where @side group by o_custkey, o_orderpriority")
TASKS = sides("select o_custkey as spec, o_orderpriority as id, max_by(o_orderstatus, o_orderkey) as title, max(o_totalprice) > 200000 as done from {orders} where @side group by o_custkey, o_orderpriority")
SCENARIO, TASK = "k.requirement || '#scenario:' || k.name", "k.spec || '#task:' || k.id"


@query(told(REQUIREMENTS, "spec, id", "k.id", ("requirement.added", "'addition'", "k.id || ' — ' || b.title", IS_NEW), ("requirement.removed", "'change'", "k.id || ' is no longer required'", IS_GONE),
    ("requirement.changed", "'change'", "k.id || ' changed'", f"{IN_BOTH} and (a.title <> b.title or a.text <> b.text)"), parents=("spec", REQUIREMENTS)) + " union all select * from ("
    + told(SCENARIOS, "requirement, name", SCENARIO, ("scenario.added", "'addition'", f"{SCENARIO} || ' is new'", IS_NEW), ("scenario.removed", "'change'", f"{SCENARIO} || ' is gone'", IS_GONE), ("scenario.changed", "'change'", f"{SCENARIO} || ' changed'", f"{IN_BOTH} and a.steps <> b.steps"), parents=("requirement", SCENARIOS)) + ") union all select * from ("
    + told(TASKS, "spec, id", TASK, ("task.added", "'addition'", "k.id || ' — ' || b.title", IS_NEW), ("task.removed", "'change'", "k.id || ' was removed'", IS_GONE), ("task.completed", "'change'", "k.id || ' was completed'", f"{IN_BOTH} and not a.done and b.done"),
    ("task.reopened", "'change'", "k.id || ' was reopened'", f"{IN_BOTH} and a.done and not b.done"), ("task.changed", "'change'", "k.id || ' changed'", f"{IN_BOTH} and a.done = b.done and a.title <> b.title"), parents=("spec", TASKS)) + ")")
def diff_specs(spark, sf_dir):
    found = changes.requirement_changes(*both(spark, sf_dir, REQUIREMENTS)).unionByName(changes.scenario_changes(*both(spark, sf_dir, SCENARIOS)))
    return found.unionByName(changes.task_changes(*both(spark, sf_dir, TASKS)))


TERMS = sides("select o_custkey as id, max_by(o_orderpriority, o_orderkey) as definition from {orders} where @side group by o_custkey")


@query(told(TERMS, "id", "k.id", ("term.added", "'addition'", "k.id || ' is defined'", IS_NEW), ("term.removed", "'change'", "k.id || ' is no longer defined'", IS_GONE), ("term.definition", "'change'", "k.id || ' means something else now'", f"{IN_BOTH} and a.definition <> b.definition")))
def diff_terms(spark, sf_dir):
    return changes.field_changes(*both(spark, sf_dir, TERMS), "term", "definition", "{id} is defined", "{id} is no longer defined", "{id} means something else now")


VERSIONS = "select o_custkey as event, dense_rank() over (partition by o_custkey order by o_orderdate, o_orderkey) as position, o_orderkey as version, o_orderpriority as field from {orders}"


@query(f"select b.event, b.position, b.version, b.field from {sub(VERSIONS)} b join {sub(VERSIONS)} a on a.event = b.event and a.position = b.position - 1 where a.field <> b.field")
def diff_added_fields(spark, sf_dir):
    return changes.added_fields(part(spark, sf_dir, VERSIONS).withColumn("position", F.col("position").cast("long")))


MARKED = sides("select o_custkey as owner, o_orderpriority as name, max_by(o_orderstatus, o_orderkey) as type, cast(count(*) as varchar(9)) as doc from {orders} where @side group by o_custkey, o_orderpriority")


@query(f"""select coalesce(a.owner, b.owner) as owner, coalesce(a.name, b.name) as name, case when a.owner is null then 'added' when b.owner is null then 'removed' else 'changed' end as mark
 from {sub(MARKED[0])} a full join {sub(MARKED[1])} b on a.owner = b.owner and a.name = b.name where a.owner is null or b.owner is null or a.type <> b.type or a.doc <> b.doc""")
def diff_field_marks(spark, sf_dir):
    return changes.field_marks(*both(spark, sf_dir, MARKED), ["owner"])


@query("""select c_mktsegment, n_name, count(*) as rows from (select '{"c_mktsegment":"' || c_mktsegment || '","n_name":"' || n_name || '"}' as v, c_mktsegment, n_name from customer join nation on c_nationkey = n_nationkey) group by v, c_mktsegment, n_name""")
def diff_canonical(spark, sf_dir):
    df = part(spark, sf_dir, "select n_name, c_mktsegment, c_custkey as source from {customer} join {nation} on c_nationkey = n_nationkey")
    found = df.groupBy(changes.canonical(df.columns).alias("v")).agg(F.count("*").alias("rows"))
    return found.select(F.get_json_object("v", "$.c_mktsegment").alias("c_mktsegment"), F.get_json_object("v", "$.n_name").alias("n_name"), "rows")
