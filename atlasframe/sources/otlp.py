"""OpenTelemetry trace files as span rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_value = "struct<stringValue: string, intValue: string, boolValue: boolean, doubleValue: double>"
_attributes = f"array<struct<key: string, value: {_value}>>"
SPAN = f"struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: string, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {_attributes}>"
OTLP = f"resourceSpans array<struct<resource: struct<attributes: {_attributes}>, scopeSpans: array<struct<spans: array<{SPAN}>>>>>"
#: The numbers of span kinds.
KINDS = {"SPAN_KIND_INTERNAL": 1, "SPAN_KIND_SERVER": 2, "SPAN_KIND_CLIENT": 3, "SPAN_KIND_PRODUCER": 4, "SPAN_KIND_CONSUMER": 5}


def attributes(c: Column) -> Column:
    """Name to text; values of other kinds than text, number and truth are left out, the last of a name counts."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))
    known = F.filter(F.coalesce(c, F.array().cast(_attributes)), lambda x: text(x["value"]).isNotNull())
    return F.aggregate(known, F.create_map().cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["key"]), F.create_map(x["key"], text(x["value"]))))


def read_spans(spark: SparkSession, paths: str | list[str], json_lines: bool = False) -> DataFrame:
    """trace_id, span_id, parent_id (null: none), name, kind, service, start, end (nanoseconds), attributes, file.

    ``json_lines``: one export per line, which lets large files be split; else one export per file.
    """
    files = spark.read.schema(OTLP).option("multiLine", not json_lines).json(paths).withColumn("file", F.col("_metadata.file_path"))
    resources = files.select("file", F.explode("resourceSpans").alias("r")).select("file", attributes(F.col("r.resource.attributes"))["service.name"].alias("service"), F.explode("r.scopeSpans").alias("s"))
    spans = resources.select("file", "service", F.explode("s.spans").alias("x"))
    kind = F.coalesce(F.col("x.kind").try_cast("int"), F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])[F.col("x.kind")], F.lit(0))
    return spans.select(
        F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.nullif(F.col("x.parentSpanId"), F.lit("")).alias("parent_id"), F.col("x.name").alias("name"), kind.alias("kind"), "service",
        F.col("x.startTimeUnixNano").cast("long").alias("start"), F.col("x.endTimeUnixNano").cast("long").alias("end"), attributes(F.col("x.attributes")).alias("attributes"), "file",
    )
