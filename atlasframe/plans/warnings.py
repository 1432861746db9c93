"""Warnings of the readers: classified, counted, and hidden by rules that a user gives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasframe.plans.rules import compile_expression

#: The fields that a policy may read.
POLICY = "plugin string, rule string, severity string, project string, phase string, ref string, message string, count long"


@dataclass(frozen=True)
class Policy:
    """Hides warnings for which ``when`` (an expression of ``plans.rules`` over the fields of ``POLICY``) holds."""

    when: str
    reason: str
    action: str = "suppress"


def slug(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit("")), F.lit("unknown"))


def warning_ref(message: Column) -> Column:
    """What stands before the first colon that a word or path follows; null if none does."""
    return F.nullif(F.trim(F.regexp_extract(message, r"^(.+?):\s+(?=[A-Za-z/])", 1)), F.lit(""))


def fingerprint(message: Column) -> Column:
    """Short hash (FNV-1a of 32 bits, in base 36) of a warning without its place, quoted values and numbers, so that warnings that differ in these only are one kind."""
    body = F.when(warning_ref(message).isNotNull(), F.regexp_replace(message, r"^(.+?):(?=\s+[A-Za-z/])", "")).otherwise(message)
    body = F.regexp_replace(F.lower(body), "`[^`]*`|\"[^\"]*\"|'[^']*'", "<value>")
    body = F.trim(F.regexp_replace(F.regexp_replace(body, r"\b\d+\b", "#"), r"\s+", " "))
    # Start and factor of the hash.
    step = lambda h, x: F.pmod(h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(0x01000193).cast("long"), F.lit(1 << 32))
    return F.lower(F.conv(F.aggregate(F.split(body, ""), F.lit(0x811C9DC5).cast("long"), lambda h, x: F.when(x == "", h).otherwise(step(h, x))).cast("string"), 10, 36))


def classify(warnings: DataFrame, ladder: list[tuple[str, str, str]]) -> DataFrame:
    """Warnings (``plugin``, ``message``) with ``rule``, ``severity`` and ``ref``: of the first step of the ladder (pattern, rule, severity) that the message meets.

    A warning that meets none is of severity ``warning`` and of a rule of its own, named by its plugin and fingerprint.
    """
    rule, severity = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for pattern, r, s in ladder:
        hit = F.col("message").rlike(f"(?i){pattern}")
        rule, severity = rule.when(hit, r), severity.when(hit, s)
    own = F.concat(F.lit("plugin."), slug(F.coalesce("plugin", F.lit(""))), F.lit(".other-"), fingerprint(F.coalesce("message", F.lit(""))))
    return warnings.withColumns({"rule": rule.otherwise(own), "severity": severity.otherwise("warning"), "ref": warning_ref(F.col("message"))})


def diagnose(warnings: DataFrame, ladder: list[tuple[str, str, str]], policies: list[Policy], step: list[str]) -> DataFrame:
    """Classified warnings with ``count`` (those of one plugin, rule and severity in one ``step``, columns of ``warnings``), ``suppressed`` and ``reason``, that of the first policy that holds.

    ``warnings``: plugin, message, project, phase. Policies are compiled before anything runs: one that can't be read, or isn't a condition, is an error (``RuleError``). Policies
    of other actions hide nothing. Counts are summed before they are joined, so a kind with very many warnings is no single task's work.
    """
    kind = [*step, "plugin", "rule", "severity"]
    classified = classify(warnings, ladder)
    counted = classified.join(classified.groupBy(*kind).agg(F.count("*").alias("count")), kind)
    schema = counted.select(*[F.col(c.split()[0]) for c in POLICY.split(", ")]).schema
    reason = F.when(F.lit(False), "")
    for policy in policies:
        holds = compile_expression(policy.when, schema, "bool")
        if policy.action == "suppress":
            reason = reason.when(holds, policy.reason)
    return counted.withColumn("reason", reason).withColumn("suppressed", F.col("reason").isNotNull())
