"""What changed between two catalogs, collection by collection, each change with its severity and a line in words.

Every collection is one full join of its two sides by key. Parts of an entity (methods, consumers, steps, ...) are told only where
both sides have the entity; of one that is new or gone, that is all there is to say.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasframe.operators.diff import SEVERITIES, status_severity
from atlasframe.operators.merge import rank_of

#: Statuses of a decision, and lifecycles of a proposal, after which its text is not to change.
SETTLED = ("accepted", "superseded")
SETTLED_PROPOSAL = ("accepted", "implemented", "rejected", "withdrawn", "abandoned", "superseded")

#: A table of the entities that each side has; where it isn't given, those that have parts.
Both = tuple[DataFrame, DataFrame]


def fill(template: str) -> Column:
    """A text with the values of the columns that it names in braces; null is empty."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


class Sides:
    """The two sides of a collection joined by ``key``; other columns are ``was_*`` and ``now_*``."""

    def __init__(self, before: DataFrame, after: DataFrame, key: list[str], where: str, within: list[str] | None = None):
        """``within``: the entity that rows are parts of; rows of one that only a side of ``parents`` has are left out by ``of``."""
        self.key, self.where, self.found = key, where, []
        side = lambda df, at: df.select(*key, *[F.col(c).alias(f"{at}_{c}") for c in df.columns if c not in key], F.lit(True).alias(f"_{at}"))
        self.rows = side(before, "was").join(side(after, "now"), key, "full_outer")

    def of(self, before: DataFrame, after: DataFrame, key: list[str]) -> Sides:
        """Only parts of entities that both sides have."""
        both = before.select(*key).distinct().join(after.select(*key).distinct(), key)
        self.rows = self.rows.join(both, key, "left_semi")
        return self

    def say(self, kind: str, severity: str | Column, summary: str | Column, when: Column, where: Column | None = None) -> Sides:
        severity = F.lit(severity) if isinstance(severity, str) else severity
        summary = fill(summary) if isinstance(summary, str) else summary
        where = F.col(self.where).cast("string") if where is None else where
        self.found.append(F.when(when, F.struct(F.lit(kind).alias("kind"), severity.alias("severity"), where.alias("where"), summary.alias("summary"))))
        return self

    def added(self, kind: str, summary: str | Column, severity: str = "addition", where: Column | None = None) -> Sides:
        return self.say(f"{kind}.added", severity, summary, F.col("_was").isNull(), where)

    def removed(self, kind: str, summary: str | Column, severity: str | Column = "change", where: Column | None = None) -> Sides:
        return self.say(f"{kind}.removed", severity, summary, F.col("_now").isNull(), where)

    def moved(self, kind: str, field: str, summary: str | Column, severity: str | Column = "change", when: Column | None = None, where: Column | None = None) -> Sides:
        both = F.col("_was").isNotNull() & F.col("_now").isNotNull() & ~F.col(f"was_{field}").eqNullSafe(F.col(f"now_{field}"))
        return self.say(kind, severity, summary, both if when is None else both & when, where)

    def changes(self) -> DataFrame:
        return self.rows.select(F.explode(F.array_compact(F.array(*self.found))).alias("_c")).select("_c.*")


def context_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id``, ``kind``, ``classification``."""
    s = Sides(before, after, ["id"], "id").added("context", 'context "{id}" is new').removed("context", 'context "{id}" is gone', "breaking")
    s = s.moved("context.kind", "kind", 'group "{id}" is a {now_kind}, was {was_kind}')
    nothing = lambda c: F.coalesce(F.col(c), F.lit("nothing"))
    return s.moved("context.classification", "classification", F.concat(fill('context "{id}" is classified '), nothing("now_classification"), F.lit(", was "), nothing("was_classification"))).changes()


def service_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id``, ``context``, ``kind``."""
    s = Sides(before, after, ["id"], "id").added("service", 'service "{id}" is new').removed("service", 'service "{id}" is gone', "breaking")
    return s.moved("service.kind", "kind", 'component "{id}" is a {now_kind}, was {was_kind}').moved("service.moved", "context", 'service "{id}" moved from {was_context} to {now_context}').changes()


def set_changes(before: DataFrame, after: DataFrame, services: tuple[DataFrame, DataFrame], kind: str, gained: str, lost: str, all_lost: str = "change") -> DataFrame:
    """Members of a set of each service (``id``, ``value``): technologies, owners, stores. ``all_lost``: the severity of a loss that leaves the set empty."""
    left = after.groupBy("id").agg(F.count("*").alias("_left"))
    s = Sides(before.distinct(), after.distinct(), ["id", "value"], "id").of(*services, ["id"])
    s.rows = s.rows.join(left, "id", "left")
    severity = F.when(F.col("_left").isNull(), all_lost).otherwise("change")
    return s.added(kind, gained, "change").removed(kind, lost, severity).changes()


def signature(m: str = "") -> Column:
    """What a caller of a method (columns ``request``, ``response``, ``streaming``, ``http_method``, ``http_path``, ``soap``) is bound to, as one text."""
    c = lambda n: F.col(f"{m}{n}")
    unknown = lambda n: F.coalesce(c(n), F.lit("?"))
    http = F.when(c("http_path").isNotNull(), F.concat(F.coalesce(F.nullif(c("http_method"), F.lit("")), F.lit("?")), F.lit(" "), c("http_path")))
    return F.concat_ws(" → ", unknown("request"), unknown("response"), F.nullif(c("streaming"), F.lit("")), http, c("soap"))


def interface_changes(before: DataFrame, after: DataFrame, services: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``service``, ``interface``; ``services``: ``service``."""
    s = Sides(before, after, ["service", "interface"], "service").of(*services, ["service"])
    return s.added("interface", '"{service}" provides {interface}').removed("interface", '"{service}" no longer provides {interface}', "breaking").changes()


def method_changes(before: DataFrame, after: DataFrame, interfaces: Both | None = None) -> DataFrame:
    """``service``, ``interface``, ``name``, ``deprecated`` and the columns of ``signature``; ``interfaces``: ``service``, ``interface``."""
    signed = [df.select("service", "interface", "name", signature().alias("signature"), F.coalesce("deprecated", F.lit(False)).alias("deprecated")) for df in (before, after)]
    s = Sides(*signed, ["service", "interface", "name"], "service").of(*(interfaces or signed), ["service", "interface"])
    s = s.added("method", "{interface} gained {name}").removed("method", "{interface} lost {name}", "breaking")
    s = s.moved("method.signature", "signature", "{interface}/{name} is now {now_signature}, was {was_signature}", "breaking")
    return s.moved("method.deprecated", "deprecated", "{interface}/{name} is deprecated", when=F.col("now_deprecated")).changes()


def call_changes(before: DataFrame, after: DataFrame, services: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``service``, ``id``, ``status``; ``services``: ``service``."""
    s = Sides(before, after, ["service", "id"], "service").of(*services, ["service"]).added("call", '"{service}" now calls {id}').removed("call", '"{service}" no longer calls {id}')
    return s.moved("call.status", "status", '"{service}" → {id} is {now_status}, was {was_status}', status_severity(F.col("was_status"), F.col("now_status"))).changes()


def channel_changes(before: DataFrame, after: DataFrame, services: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``service``, ``address``; ``services``: ``service``."""
    s = Sides(before, after, ["service", "address"], "service").of(*services, ["service"])
    return s.added("channel", '"{service}" declares channel {address}').removed("channel", '"{service}" no longer declares channel {address}', "breaking").changes()


def encoding_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``service``, ``address``, ``direction``, ``name``, ``encoding`` of messages that both sides have."""
    known = [df.withColumn("encoding", F.coalesce("encoding", F.lit(""))) for df in (before, after)]
    said = lambda c, none: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(none))
    text = F.concat(fill("{direction} message {name} on {address} uses "), said("now_encoding", "an unspecified encoding"), F.lit(", was "), said("was_encoding", "unspecified"))
    severity = F.when((F.col("was_encoding") != "") & (F.col("now_encoding") != ""), "breaking").otherwise("change")
    return Sides(*known, ["service", "address", "direction", "name"], "service").moved("message.encoding", "encoding", text, severity).changes()


def entity_changes(before: DataFrame, after: DataFrame, kind: str, new: str, gone: str, gone_severity: str = "change") -> DataFrame:
    """``id`` that one side has and the other hasn't: aggregates, flows, specifications."""
    return Sides(before, after, ["id"], "id").added(kind, new).removed(kind, gone, gone_severity).changes()


def part_changes(before: DataFrame, after: DataFrame, kind: str, new: str, gone: str, gone_severity: str = "change", owners: Both | None = None) -> DataFrame:
    """``id`` of parts of ``owner``: operations of an aggregate, states and transitions of a lifecycle, tables of a store. ``owners``: ``owner``, also those without parts."""
    s = Sides(before, after, ["owner", "id"], "owner").of(*(owners or (before, after)), ["owner"])
    return s.added(kind, new).removed(kind, gone, gone_severity).changes()


def event_changes(before: DataFrame, after: DataFrame, aggregates: Both | None = None) -> DataFrame:
    """``aggregate``, ``id``, ``consumers`` (how many); ``aggregates``: ``aggregate``."""
    s = Sides(before, after, ["aggregate", "id"], "id").of(*(aggregates or (before, after)), ["aggregate"])
    s = s.added("event", F.when(F.col("now_consumers") == 0, fill("{id} is published, and nothing consumes it")).otherwise(fill("{id} is published, consumed by {now_consumers}")))
    return s.removed("event", F.when(F.col("was_consumers") == 0, fill("{id} is gone")).otherwise(fill("{id} is gone, and {was_consumers} consumed it")), "breaking").changes()


def consumer_changes(before: DataFrame, after: DataFrame, events: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``event``, ``consumer``, ``status``; ``events``: ``event``."""
    s = Sides(before, after, ["event", "consumer"], "event").of(*events, ["event"]).added("consumer", "{consumer} consumes {event}").removed("consumer", "{consumer} no longer consumes {event}")
    return s.moved("consumer.status", "status", "{consumer} consuming {event} is {now_status}, was {was_status}", status_severity(F.col("was_status"), F.col("now_status"))).changes()


def store_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id``, ``owner``."""
    s = Sides(before, after, ["id"], "id").added("store", 'store "{id}" is new').removed("store", 'store "{id}" is gone', "breaking")
    return s.moved("store.owner", "owner", 'store "{id}" is owned by {now_owner}, was {was_owner}', "breaking").changes()


def short_commit(c: str) -> Column:
    return F.coalesce(F.substring(F.nullif(F.col(c), F.lit("")), 1, 7), F.lit("nothing"))


def pin_changes(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    """``id``, ``commit`` of modules (``kind`` module) or vendored repositories (repo)."""
    s = Sides(before, after, ["id"], "id")
    if kind == "module":
        s = s.added(kind, 'module "{id}" is new').removed(kind, 'module "{id}" is gone', "breaking")
        return s.moved("module.commit", "commit", F.concat(fill('module "{id}" is at '), short_commit("now_commit"), F.lit(", was "), short_commit("was_commit"))).changes()
    s = s.added(kind, F.concat(fill("{id} is vendored at "), short_commit("now_commit"))).removed(kind, "{id} is no longer vendored")
    return s.moved("repo.commit", "commit", F.concat(fill("{id} moved from "), short_commit("was_commit"), F.lit(" to "), short_commit("now_commit"))).changes()


def step_changes(before: DataFrame, after: DataFrame, flows: Both | None = None) -> DataFrame:
    """``flow``, ``slug`` (one of a flow's two sides), ``id``, ``text`` (from, to and label), ``status``; ``flows``: ``flow``."""
    s = Sides(before, after, ["flow", "id"], "flow").of(*(flows or (before, after)), ["flow"]).added("step", "{now_slug} gained {now_text}").removed("step", "{was_slug} lost {was_text}")
    return s.moved("step.status", "status", "{was_slug} step {id} is {now_status}, was {was_status}", status_severity(F.col("was_status"), F.col("now_status"))).changes()


def decision_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id``, ``title``, ``status``, ``superseded_by``, ``body``."""
    s = Sides(before, after, ["id"], "id").added("adr", "{id} — {now_title}").removed("adr", "{id} is gone").moved("adr.status", "status", "{id} is {now_status}, was {was_status}")
    s = s.moved("adr.superseded", "superseded_by", "{id} is superseded by {now_superseded_by}", when=F.coalesce("now_superseded_by", F.lit("")) != "")
    return s.moved("adr.body", "body", "{id} was edited after being {was_status}", when=F.col("was_status").isin(*SETTLED)).changes()


def proposal_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``id``, ``display``, ``title``, ``status``, ``lifecycle``, ``repository``, ``body``."""
    stated = [df.withColumn("_stated", F.struct("status", "lifecycle")) for df in (before, after)]
    home = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("the catalog repository"))
    s = Sides(*stated, ["id"], "id").added("rfc", "{now_display} — {now_title}").removed("rfc", "{was_display} is gone")
    moved = F.when(~F.col("was_lifecycle").eqNullSafe(F.col("now_lifecycle")), fill(" ({now_lifecycle}, was {was_lifecycle})")).otherwise("")
    s = s.moved("rfc.status", "_stated", F.concat(fill("{now_display} is {now_status}, was {was_status}"), moved))
    s = s.moved("rfc.repository", "repository", F.concat(fill("{now_display} moved from "), home("was_repository"), F.lit(" to "), home("now_repository")))
    return s.moved("rfc.body", "body", "{now_display} was edited after being {was_lifecycle}", when=F.col("was_lifecycle").isin(*SETTLED_PROPOSAL)).changes()


def requirement_changes(before: DataFrame, after: DataFrame, specs: Both | None = None) -> DataFrame:
    """``spec``, ``id``, ``title``, ``text``; ``specs``: ``spec``."""
    told = [df.withColumn("_said", F.struct("title", "text")) for df in (before, after)]
    s = Sides(*told, ["spec", "id"], "id").of(*(specs or (before, after)), ["spec"]).added("requirement", "{id} — {now_title}").removed("requirement", "{id} is no longer required")
    return s.moved("requirement.changed", "_said", "{id} changed").changes()


def scenario_changes(before: DataFrame, after: DataFrame, requirements: Both | None = None) -> DataFrame:
    """``requirement``, ``name``, ``steps`` (its conditions and outcomes, as one value); ``requirements``: ``requirement``."""
    where = F.concat("requirement", F.lit("#scenario:"), "name")
    s = Sides(before, after, ["requirement", "name"], "requirement").of(*(requirements or (before, after)), ["requirement"])
    s = s.added("scenario", F.concat(where, F.lit(" is new")), where=where).removed("scenario", F.concat(where, F.lit(" is gone")), where=where)
    return s.moved("scenario.changed", "steps", F.concat(where, F.lit(" changed")), where=where).changes()


def task_changes(before: DataFrame, after: DataFrame, specs: Both | None = None) -> DataFrame:
    """``spec``, ``id``, ``title``, ``done``; ``specs``: ``spec``."""
    where = F.concat("spec", F.lit("#task:"), F.col("id").cast("string"))
    s = Sides(before, after, ["spec", "id"], "spec").of(*(specs or (before, after)), ["spec"]).added("task", "{id} — {now_title}", where=where).removed("task", "{id} was removed", where=where)
    s = s.moved("task.completed", "done", "{id} was completed", when=F.col("now_done"), where=where).moved("task.reopened", "done", "{id} was reopened", when=~F.col("now_done"), where=where)
    return s.moved("task.changed", "title", "{id} changed", when=F.col("was_done").eqNullSafe(F.col("now_done")), where=where).changes()


def field_changes(before: DataFrame, after: DataFrame, kind: str, field: str, new: str, gone: str, moved: str) -> DataFrame:
    """``id`` and one ``field``: definitions of terms, lifecycles of specifications."""
    return Sides(before, after, ["id"], "id").added(kind, new).removed(kind, gone).moved(f"{kind}.{field}", field, moved).changes()


def added_fields(versions: DataFrame) -> DataFrame:
    """Fields of each version (``event``, ``position``, ``version``, ``field``) that the version before it hasn't; of first versions, none."""
    before = versions.select("event", (F.col("position") + 1).alias("position"), "field")
    known = before.select("event", "position").distinct()
    return versions.join(known, ["event", "position"], "left_semi").join(before, ["event", "position", "field"], "left_anti")


def field_marks(main: DataFrame, branch: DataFrame, key: list[str]) -> DataFrame:
    """How each field (``key``, ``name``, ``type``, ``doc``) of a branch stands to main's: added, changed, removed; equal ones are left out."""
    value = F.struct("type", "doc")
    a, b = (df.select(*key, "name", value.alias(v)) for df, v in ((main, "_main"), (branch, "_branch")))
    mark = F.when(F.col("_main").isNull(), "added").when(F.col("_branch").isNull(), "removed").when(~F.col("_main").eqNullSafe(F.col("_branch")), "changed")
    return a.join(b, [*key, "name"], "full_outer").select(*key, "name", mark.alias("mark")).where("mark is not null")


def canonical(columns: list[str], dropped: tuple[str, ...] = ("source", "commit", "generatedAt")) -> Column:
    """A row's value as JSON with its fields in the order of their names, without where it came from, so that equal values are equal texts."""
    return F.to_json(F.struct(*sorted(c for c in columns if c not in dropped)))


def ordered(changes: list[DataFrame]) -> DataFrame:
    """All changes, breaking ones first."""
    return reduce(DataFrame.unionByName, changes).orderBy(rank_of(F.col("severity"), SEVERITIES), "where", "kind", "summary")
