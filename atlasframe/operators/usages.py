"""Who uses what, who owns what, and how much of it there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.operators.blocks import join_in_blocks
from atlasframe.plans.checkpoints import kept

#: Fixed value: as many rows are few enough to be sent to all tasks.
FEW = 10_000


def distinct_links(links: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first link of each (kind, id): all columns."""
    return links.groupBy(*key).agg(F.min_by(F.struct(*links.columns), F.struct(*order)).alias("_r")).select("_r.*")


def usages(fields: DataFrame, by: str, target: str, exclude: DataFrame | None = None) -> DataFrame:
    """Fields whose ``by`` names a shared type: ``target``, and the columns of ``fields``. ``exclude`` (``target``, ``owner``): owners whose own fields don't count."""
    found = fields.where(F.col(by).isNotNull() & (F.col(by) != "")).withColumn(target, F.col(by))
    return found if exclude is None else found.join(exclude, [target, "owner"], "left_anti")


def usage_counts(found: DataFrame, target: str, version: str) -> DataFrame:
    """How many fields of how many owners use each type, and the newest version that does."""
    return found.groupBy(target).agg(F.count("*").alias("fields"), F.count_distinct("owner").alias("owners"), F.max(version).alias("latest"))


def named_links(fields: DataFrame, enums: DataFrame, scope: list[str]) -> DataFrame:
    """Fields typed by an enum: by its id (``ref``), else by its name inside ``scope``: id, owner, field, by_name.

    Ids and names of enums are written first, so that Spark knows how small they are. Where enums have few different names, a field whose type is none of them goes nowhere.
    """
    known = kept(enums.select(F.col("id").alias("ref")).distinct())
    by_id = fields.join(known, "ref").select(F.col("ref").alias("id"), "owner", "field", F.lit(False).alias("by_name"))
    called = kept(enums.select(*scope, F.col("name").alias("type"), "id"))
    names = kept(called.select(*scope, "type").distinct())
    typed = fields.join(F.broadcast(names), [*scope, "type"], "left_semi") if names.count() <= FEW else fields
    rest = typed.join(known, "ref", "left_anti").select(*scope, "type", "owner", "field")
    by_name = join_in_blocks(rest, called, [*scope, "type"]).select("id", "owner", "field", F.lit(True).alias("by_name"))
    return by_id.unionByName(by_name)


def first_of_each(rows: DataFrame, key: list[str], order: list[str], take: list[str]) -> DataFrame:
    """The first row of each key in ``order``: the step that runs an operation in a flow, the interface that declares a method."""
    return rows.groupBy(*key).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in take])


def repository_lane(lanes: DataFrame) -> DataFrame:
    """The service whose repository holds a flow: its first service lane in the owner's context, else its first service lane. ``lanes``: flow, ord, service, context, owner."""
    foreign = (~F.col("context").eqNullSafe(F.col("owner"))).cast("int")
    return lanes.where("service is not null").groupBy("flow").agg(F.min_by("service", F.struct(foreign, "ord")).alias("service"))


def listed_or_owned(owned: DataFrame, listed: DataFrame, key: list[str]) -> DataFrame:
    """Stores of services: those they own and those they list, once each, with ``owns``."""
    both = owned.select(*key, F.lit(True).alias("owns")).unionByName(listed.select(*key, F.lit(False).alias("owns")))
    return both.groupBy(*key).agg(F.bool_or("owns").alias("owns"))


def owners(services: DataFrame, scope: list[str]) -> DataFrame:
    """Owners (array ``owners``) and how many services each has, by ``scope``: owner (null: nobody), services, place (most first, then by name; nobody last)."""
    each = services.select(*scope, "service", F.explode_outer(F.when(F.size("owners") > 0, F.col("owners"))).alias("owner")).distinct()
    n = each.groupBy(*scope, "owner").agg(F.count("*").alias("services"))
    if not scope:  # one small row for each owner
        return n
    w = Window.partitionBy(*scope).orderBy(F.col("owner").isNull(), F.desc("services"), "owner")
    return n.withColumn("place", F.row_number().over(w).cast("long"))


def owned_flows(flows: DataFrame, health: tuple[str, ...]) -> DataFrame:
    """Flows (``flow``, ``owner``, ``name``, ``health``) by their owner, the weakest health first, then by name: owner, place, flow."""
    from atlasframe.operators.merge import rank_of

    w = Window.partitionBy("owner").orderBy(rank_of(F.col("health"), health), "name", "flow")
    return flows.withColumn("place", F.row_number().over(w).cast("long")).select("owner", "place", "flow")


def kind_counts(rows: DataFrame, key: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """How many rows of each kind: blocks of an aggregate, nodes of a chain, changes of a task."""
    return rows.groupBy(*key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def packages(interfaces: DataFrame, module: str, ident: str) -> DataFrame:
    """Interfaces of a module by their package, the part of the id before its last dot (none: empty): module, package, interfaces."""
    package = F.when(F.col(ident).contains("."), F.regexp_replace(F.col(ident), r"\.[^.]*$", "")).otherwise("")
    return interfaces.groupBy(module, package.alias("package")).agg(F.count_distinct(ident).alias("interfaces"))


def module_counts(interfaces: DataFrame, methods: DataFrame, messages: DataFrame, module: str) -> DataFrame:
    """Interfaces, methods and messages of each module; 0 where there are none."""
    out = None
    for name, df in (("interfaces", interfaces), ("methods", methods), ("messages", messages)):
        n = df.groupBy(module).agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, module, "full_outer")
    return out.select(module, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("interfaces", "methods", "messages")])


def unmapped(fields: DataFrame, mapped: DataFrame, key: list[str], name: str) -> DataFrame:
    """How many fields of each ``key`` no column maps (``name``: the first part of the mapped path): key, fields, unmapped."""
    known = mapped.select(*key, F.substring_index(name, ".", 1).alias(name)).distinct().withColumn("_m", F.lit(True))
    return fields.join(known, [*key, name], "left").groupBy(*key).agg(F.count("*").alias("fields"), F.count_if(F.col("_m").isNull()).alias("unmapped"))


def users_but_owner(uses: DataFrame, modules: DataFrame) -> DataFrame:
    """Services that use a module and don't own it: module, service. ``uses``: module, service; ``modules``: module, owner."""
    return uses.select("module", "service").distinct().join(modules.select("module", F.col("owner").alias("service")), ["module", "service"], "left_anti")


def covers(scope: Column, services: Column, service: Column, context: Column) -> Column:
    """Does a decision or proposal concern a service? Its ``scope`` (kind ``org``, ``context`` or ``service``) is the whole estate, the service's context or the service itself, or its list of ``services`` names it."""
    kind = scope["kind"]
    scoped = (kind == "org") | ((kind == "service") & (scope["service"] == service)) | ((kind == "context") & (scope["context"] == context))
    return F.coalesce(scoped, F.lit(False)) | F.coalesce(F.array_contains(services, service), F.lit(False))


def concerning(records: DataFrame, services: DataFrame) -> DataFrame:
    """Decisions and proposals by what they concern: service (null: every service of the estate), id, by (org, scope or name; the least of several).

    ``records``: id, scope (kind, context, service), relates (services); ``services``: service, context. Those of the whole estate come once, not once for
    each service; so the ones of a service are the rows with its name and those with none. A record of the whole estate that names a service too comes once.
    """
    kind = F.col("scope.kind")
    everywhere = records.where(kind == "org").select(F.lit(None).cast(services.schema["service"].dataType).alias("service"), "id", F.lit("org").alias("by")).distinct()
    rest = records.where(~F.coalesce(kind == "org", F.lit(False)))
    inside = rest.where(kind == "context").select("id", F.col("scope.context").alias("context")).distinct()
    known = services.select("service").distinct()
    own = rest.where(kind == "service").select("id", F.col("scope.service").alias("service")).join(known, "service").select("service", "id", F.lit("scope").alias("by"))
    named = rest.select("id", F.explode("relates.services").alias("service")).join(known, "service").select("service", "id", F.lit("name").alias("by"))
    # A service of one context meets its context's records once, so these many pairs need no grouping if the records know which services are told already.
    home = services.where("context is not null").groupBy("service").agg(F.min("context").alias("context"), F.max("context").alias("_other"))
    single = home.where("context = _other").drop("_other")
    several = services.join(home.where("context <> _other").select("service"), "service", "left_semi").select("service", "context").distinct()
    told = named.unionByName(own)
    few = told.unionByName(several.join(inside, "context").select("service", "id", F.lit("scope").alias("by"))).groupBy("service", "id").agg(F.min("by").alias("by"))
    but = told.join(single, "service").groupBy(F.col("id").alias("_id"), F.col("context").alias("_in")).agg(F.collect_set("service").alias("_but"))
    inside = inside.join(but, F.col("id").eqNullSafe(F.col("_id")) & (F.col("context") == F.col("_in")), "left").select("id", "context", "_but")
    many = join_in_blocks(inside, single, ["context"]).where(~F.coalesce(F.array_contains("_but", F.col("service")), F.lit(False)))
    return few.unionByName(many.select("service", "id", F.lit("scope").alias("by"))).unionByName(everywhere)


def newest(records: DataFrame, status: str, n: int, date: str = "date", ident: str = "id") -> DataFrame:
    """The ``n`` newest records of a status, the latest first, ties by id."""
    return records.where(F.col("status") == status).orderBy(F.desc(date), F.asc(ident)).limit(n)


def same_words(a: Column, b: Column) -> Column:
    """Are two lists of names the same sets, but for case and marks? Empty lists are the same as nothing."""
    fold = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))))
    return F.coalesce((F.size(a) > 0) & (F.size(b) > 0) & (fold(a) == fold(b)), F.lit(False))


def row_differences(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows that match one version of a rule only (``matched``): key, change (added or gone)."""
    a, b = (df.where("matched").select(*key).distinct().withColumn(n, F.lit(True)) for df, n in ((before, "_a"), (after, "_b")))
    return a.join(b, key, "full_outer").where("_a is null or _b is null").select(*key, F.when(F.col("_a").isNull(), "added").otherwise("gone").alias("change"))


def explain(shorts: DataFrame, terms: DataFrame, common: DataFrame) -> DataFrame:
    """Abbreviations with what they mean: by the terms (of several, the first by id), else by the common list: short, meaning, source (null: unknown)."""
    own = terms.groupBy("short").agg(F.min_by("meaning", "id").alias("_own"))
    known = common.groupBy("short").agg(F.min("meaning").alias("_common"))
    out = shorts.select("short").distinct().join(own, "short", "left").join(known, "short", "left")
    return out.select("short", F.coalesce("_own", "_common").alias("meaning"), F.when(F.col("_own").isNotNull(), "term").when(F.col("_common").isNotNull(), "common").alias("source"))


def arranged(branches: DataFrame, now: Column, days: int = 90, words: str = "") -> DataFrame:
    """Branches (``name``, ``updated``) that a list shows, each with ``stale``: without a search stale ones are hidden, with one all that contain its words stay."""
    marked = branches.withColumn("stale", F.coalesce(F.datediff(now, F.col("updated")) > days, F.lit(True)))
    if words.strip():
        return marked.where(F.forall(F.array(*[F.contains(F.lower("name"), F.lit(w.lower())) for w in words.split()]), lambda x: x))
    return marked.where("not stale")


def ref_rank(name: Column, kind: Column, current: str) -> Column:
    """Order of references: the current branch, main, other branches, tags."""
    branch = kind == "branch"
    return F.when(branch & (name == current), 0).when(branch & (name == "main"), 1).when(branch, 2).otherwise(3)


def streaming_kind(streaming: Column) -> Column:
    return F.coalesce(F.nullif(streaming, F.lit("")), F.lit("unary"))


def tech_key(name: Column) -> Column:
    """One spelling of a technology's name: lower case, only letters, digits, ``+`` and ``#``."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9+#]", "")


def drift_texts() -> Column:
    """Where the tree and what is deployed disagree, a text for each field, over the columns of a deployment: ``drift`` (what the tree says of fields that differ) and the fields themselves."""
    line = lambda f, verb: F.when(F.col(f"drift.{f}") != "", F.concat(F.lit(f"{verb} "), F.col(f"drift.{f}"), F.lit(" in the tree, "), F.coalesce(f, F.lit("")), F.lit(" deployed")))
    running = F.coalesce(F.nullif(F.array_join(F.coalesce("images", F.array().cast("array<string>")), ", "), F.lit("")), F.lit("nothing"))
    pins = F.when(F.size("drift.images") > 0, F.concat(F.lit("pins "), F.array_join("drift.images", ", "), F.lit(" in the tree; running "), running))
    # The words of the texts, in their order.
    return F.array_compact(F.array(line("project", "project"), line("cluster", "cluster"), line("namespace", "namespace"), line("path", "path"), line("targetRevision", "tracks"), pins))


def drift_lines(deployments: DataFrame, key: list[str]) -> DataFrame:
    """``drift_texts`` of each deployment as rows: key, place (order of the lines), line."""
    return deployments.select(*key, F.posexplode(drift_texts()).alias("place", "line"))


def shared_kernel(blocks: DataFrame) -> DataFrame:
    """Shared types that the models of two contexts both name (``context``, ``def``): left, right, def; a join by type, each pair once."""
    one = blocks.where("def is not null").select("context", "def").distinct()
    return one.select(F.col("context").alias("left"), "def").join(one.select(F.col("context").alias("right"), "def"), "def").where(F.col("left") < F.col("right")).select("left", "right", "def")


def isolated(nodes: DataFrame, ident: str, edges: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes that no edge touches."""
    touched = edges.select(F.col(source).alias(ident)).unionByName(edges.select(F.col(target).alias(ident))).distinct()
    return nodes.join(touched, ident, "left_anti")


def emitters(operations: DataFrame, transitions: DataFrame) -> DataFrame:
    """What gives out each event: operations (``id``, ``emits`` array) and transitions (``from``, ``on``, ``to``, ``emits``) as event, kind, by."""
    ops = operations.select(F.explode("emits").alias("event"), F.lit("operation").alias("kind"), F.col("id").cast("string").alias("by"))
    moves = transitions.where("emits is not null and emits <> ''").select(F.col("emits").alias("event"), F.lit("transition").alias("kind"), F.concat_ws(" ", "from", "on", "to").alias("by"))
    return ops.unionByName(moves).distinct()
