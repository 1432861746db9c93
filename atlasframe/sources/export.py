"""Sinks: CSV that spreadsheets can't run, Markdown tables, sequence diagrams, and change reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasframe.functions.text import csv_cell, markdown_cell


def csv_lines(df: DataFrame) -> DataFrame:
    """One ``line`` per row (without the header), cells guarded and quoted."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`").cast("string")) for c in df.columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Guarded cells through Spark's own writer, a header in each file."""
    guarded = [F.when(F.col(f"`{c}`").cast("string").rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), F.col(f"`{c}`").cast("string"))).otherwise(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]
    df.select(*guarded).write.option("header", True).option("escape", '"').option("lineSep", "\r\n").mode("overwrite").csv(path)


def markdown_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_cell(F.col(f"`{c}`").cast("string")) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown_head(df: DataFrame) -> str:
    return "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)



def sequence_diagram(nodes: DataFrame, participants: DataFrame) -> DataFrame:
    """One diagram text per flow from ``flow_nodes`` and ``participants`` (a flow's steps are few): flow_id, diagram."""
    lanes = participants.groupBy(F.col("flow").alias("flow_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("  participant "), F.regexp_replace("id", r"[^A-Za-z0-9_]", "_")))).alias("lanes"))
    name = lambda c: F.regexp_replace(F.col(c), r"[^A-Za-z0-9_]", "_")
    arrow = F.when(F.col("kind") == "event", "-)").when(F.col("kind") == "response", "-->>").otherwise("->>")
    text = F.when(F.col("type") == "step", F.concat(F.lit("  "), name("from"), arrow, name("to"), F.lit(": "), F.coalesce("label", "ref", F.lit("?")))).otherwise(F.concat(F.lit("  %% "), "type", F.lit(" "), "node_id"))
    lines = nodes.groupBy("flow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("text")))), lambda x: x["text"]).alias("lines"))
    return lines.join(lanes, "flow_id", "left").select("flow_id", F.concat_ws("\n", F.lit("sequenceDiagram"), F.array_join(F.coalesce("lanes", F.array().cast("array<string>")), "\n"), F.array_join("lines", "\n")).alias("diagram"))


def sarif_results(changes: DataFrame) -> DataFrame:
    """Changes as SARIF results, one JSON text per row."""
    level = F.when(F.col("severity") == "breaking", "error").when(F.col("severity") == "change", "warning").otherwise("note")
    message = F.concat_ws(" ", "entity", "where", "kind", "field")
    return changes.select(F.to_json(F.struct(F.concat_ws("-", "entity", "kind").alias("ruleId"), level.alias("level"), F.struct(message.alias("text")).alias("message"))).alias("result"))
