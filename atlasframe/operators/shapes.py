"""Types of fields and columns: their parts, their classes, and the shapes they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of database types by class.
DB_CLASSES = {
    "uuid": ["uuid"],
    "text": ["text", "varchar", "character varying", "character", "char", "citext"],
    "int16": ["smallint", "int2", "smallserial"],
    "int32": ["integer", "int", "int4", "serial"],
    "int64": ["bigint", "int8", "bigserial"],
    "decimal": ["numeric", "decimal", "money"],
    "float": ["real", "float4", "double precision", "float8"],
    "bool": ["boolean", "bool"],
    "time": ["timestamptz", "timestamp with time zone", "timestamp", "timestamp without time zone", "date", "time", "timetz"],
    "json": ["jsonb", "json"],
    "bytes": ["bytea"],
}
#: Spellings of model types by class.
MODEL_CLASSES = {
    "text": ["string"],
    "uuid": ["uuid.uuid", "uuid"],
    "int16": ["int16", "short"],
    "int32": ["int32", "rune", "uint32", "integer"],
    "int64": ["int64", "uint64", "time.duration", "long"],
    "int": ["int"],
    "float": ["float32", "float64", "double"],
    "bool": ["bool", "boolean"],
    "time": ["time.time", "instant", "offsetdatetime", "localdatetime", "localdate", "date"],
    "decimal": ["decimal.decimal", "bigdecimal"],
    "json": ["json.rawmessage"],
    "bytes": ["byte"],
}
#: Wrappers that mean many, maybe none, nothing, and many by a key.
MANY = ("Vec", "VecDeque", "HashSet", "BTreeSet", "List", "Set", "Array", "ReadonlyArray", "Iterable", "Sequence", "Collection")
OPTIONAL = ("Option", "Optional", "Maybe", "Nullable")
BOXES = ("Box", "Rc", "Arc", "Readonly", "Cow")
MAPS = ("map", "Map", "HashMap", "BTreeMap", "Record", "Dictionary")
SHAPE_DEPTH = 6
#: Fixed value: segments of a path that name no family.
TECHNICAL = r"(?i)^(api|v\d+)$"


#: One match of a spelling: pointer and list marks in front, the name, and lengths or precisions behind, which don't belong to it.
SPELLING = r"^[*]*(?:\[\])?(.*?)(?:\(.*\))?$"


def core_name(type_: Column) -> Column:
    """The name of a type as it is looked up: in lower case, with single blanks, without marks and parameters."""
    words = F.split(F.regexp_extract(F.lower(F.trim(type_)), SPELLING, 1), r"\s+")
    return F.array_join(words, " ")


def class_of(type_: Column, classes: dict[str, list[str]]) -> Column:
    """The class whose spellings have the type's name; ``unknown`` where none has."""
    known = F.create_map(*[F.lit(x) for k, spellings in classes.items() for s in spellings for x in (s, k)])
    return F.coalesce(F.try_element_at(known, core_name(type_)), F.lit("unknown"))


def db_class(type_: Column) -> Column:
    return class_of(type_, DB_CLASSES)


def model_class(type_: Column) -> Column:
    return class_of(type_, MODEL_CLASSES)


#: The database classes that hold what a model class means; an ``int`` of no stated width may lie in any whole number.
FITTING = {k: [k] for k in MODEL_CLASSES} | {"int": ["int", "int16", "int32", "int64"]}


def types_disagree(db: Column, model: Column) -> Column:
    """Both types are known, and the database's isn't among those that hold the model's."""
    fitting = F.create_map(*[x for k, v in FITTING.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    held = F.try_element_at(fitting, model_class(model))  # null for unknown ones
    return F.coalesce((db_class(db) != "unknown") & ~F.array_contains(held, db_class(db)), F.lit(False))


def type_parts(type_: Column) -> Column:
    """(base, many, optional, by_key) of a type's spelling, without all its wrappers; of a map, the type of its values.

    Each round takes one wrapper off; there are as many rounds as the spelling has marks that may be wrappers. ``many``: more
    than one, by position or (``by_key``) by key; the outermost of list and map tells which. Other generics stay whole.
    """
    maybe = rf"^optional\s+(.+)$|^[*?](.+)$|^(.+)\?$|^(.+?)\s*\|\s*(?:undefined|null)$|^(?:{'|'.join(OPTIONAL)})<(.+)>$"
    many = rf"^repeated\s+(.+)$|^\[\](.+)$|^(.+)\[\]$|^(?:{'|'.join(MANY)})<(.+)>$"
    box = rf"^(?:{'|'.join(BOXES)})<(.+)>$"
    key = rf"^(?:{'|'.join(MAPS)})<[^<>,]+,\s*(.+)>$"

    def step(acc: Column, _: Column) -> Column:
        base = acc["base"]
        is_maybe, is_many, is_box, is_key = (base.rlike(x) for x in (maybe, many, box, key))
        is_many, is_box, is_key = ~is_maybe & is_many, ~is_maybe & ~is_many & is_box, ~is_maybe & ~is_many & ~is_box & is_key
        inner = F.when(is_maybe, F.regexp_replace(base, maybe, "$1$2$3$4$5")).when(is_many, F.regexp_replace(base, many, "$1$2$3$4")).when(is_box, F.regexp_replace(base, box, "$1")).when(is_key, F.regexp_replace(base, key, "$1")).otherwise(base)
        return F.struct(F.trim(inner).alias("base"), (acc["many"] | is_many | is_key).alias("many"), (acc["optional"] | is_maybe).alias("optional"), (acc["by_key"] | (is_key & ~acc["many"])).alias("by_key"))

    start = F.struct(F.trim(type_).alias("base"), F.lit(False).alias("many"), F.lit(False).alias("optional"), F.lit(False).alias("by_key"))
    rounds = F.length(F.regexp_replace(type_, r"[^<\[*?|\s]", "")) + 1
    return F.when(type_.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.coalesce(rounds, F.lit(1))), start, step))


def resolve_shapes(fields: DataFrame, defs: DataFrame, blocks: DataFrame, enums: DataFrame) -> DataFrame:
    """What each field's type names: the definition of its ref; else a block, else an enum, of its aggregate, then of its service.

    ``fields``: field_id, type, ref, aggregate, service; ``defs``: def_id; ``blocks`` and ``enums``: id, name, aggregate, service. Only
    capitalised names are looked up. A name that several shapes of one stage bear takes the first by id. Adds kind and shape.
    """
    named = fields.withColumn("_base", type_parts(F.col("type"))["base"])
    named = named.withColumn("_base", F.when(F.col("_base").rlike("^[A-Z]"), F.col("_base")))
    shapes = blocks.select("id", "name", "aggregate", "service", F.lit("block").alias("kind")).unionByName(enums.select("id", "name", "aggregate", "service", F.lit("enum").alias("kind")))
    first = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct("kind", "id")).alias("_s"))
    own = first(shapes, "aggregate", "name").withColumnsRenamed({"name": "_base", "_s": "_own"})
    near = first(shapes, "service", "name").withColumnsRenamed({"name": "_base", "_s": "_near"})
    out = named.join(defs.select(F.col("def_id").alias("ref")).distinct().withColumn("_def", F.lit(True)), "ref", "left").join(own, ["aggregate", "_base"], "left").join(near, ["service", "_base"], "left")
    picked = F.coalesce(F.when(F.col("_def"), F.struct(F.lit("def").alias("kind"), F.col("ref").alias("id"))), F.col("_own"), F.col("_near"))
    return out.withColumn("kind", picked["kind"]).withColumn("shape", picked["id"]).drop("_base", "_def", "_own", "_near")


def openable_paths(roots: DataFrame, shape_fields: DataFrame, depth: int = SHAPE_DEPTH) -> DataFrame:
    """Nested field paths that open on to another shape: root, path, shape, depth; a shape on the way is not entered again.

    ``roots``: root, shape; ``shape_fields``: shape, name, target (the shape a field names, or null).
    """
    f = shape_fields.where("target is not null").select(F.col("shape").alias("_at"), "name", "target")
    level = roots.select("root", F.col("shape").alias("_at"), F.lit("").alias("path"), F.array("shape").alias("_way"))
    out = None
    for k in range(1, depth):
        level = level.join(f, "_at").where(~F.array_contains("_way", F.col("target"))).select("root", F.col("target").alias("_at"), F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("."), "name")).alias("path"), F.concat("_way", F.array("target")).alias("_way"))
        part = level.select("root", "path", F.col("_at").alias("shape"), F.lit(k).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out


def field_differences(copies: DataFrame, originals: DataFrame) -> DataFrame:
    """Copied interfaces against their providers': copy, differences (sorted texts).

    Both sides: copy, message, field, type. A field that either lacks, or has with another type, is a difference.
    """
    a = copies.select("copy", "message", "field", F.col("type").alias("_a"))
    b = originals.select("copy", "message", "field", F.col("type").alias("_b"))
    name = F.concat("message", F.lit("."), "field")
    text = F.when(F.col("_b").isNull(), F.concat(name, F.lit(" is not published"))).when(F.col("_a").isNull(), F.concat(name, F.lit(" is missing"))).when(F.col("_a") != F.col("_b"), F.concat(name, F.lit(" is "), "_a", F.lit(", published as "), "_b"))
    return a.join(b, ["copy", "message", "field"], "full_outer").withColumn("_t", text).where("_t is not null").groupBy("copy").agg(F.array_sort(F.collect_list("_t")).alias("differences"))


def method_groups(methods: DataFrame, least: int = 20) -> DataFrame:
    """Route families of large HTTP interfaces: interface, name, family (null: on its own).

    ``methods``: interface, name, path. The family is the first segment that is neither a version, ``api`` nor a parameter in braces; it counts where
    at least two methods share it and the interface has ``least`` methods with a family.
    """
    parts = F.filter(F.split(F.col("path"), "/"), lambda x: (x != "") & ~x.startswith("{") & ~x.rlike(TECHNICAL))
    found = methods.withColumn("_f", F.get(parts, F.lit(0)))
    size = found.groupBy("interface").agg(F.count("_f").alias("_n"))
    shared = found.groupBy("interface", "_f").agg(F.count("*").alias("_m"))
    return found.join(size, "interface").join(shared, ["interface", "_f"], "left").select("interface", "name", F.when((F.col("_n") >= least) & (F.col("_m") >= 2), F.col("_f")).alias("family"))


def integrations(calls: DataFrame, methods: DataFrame, services: DataFrame, externals: DataFrame) -> DataFrame:
    """Outbound calls by peer: service, peer, kind, operations, documented, protocols.

    ``methods``: service, id (interface/method), http (whether it has a route).
    """
    known = services.select(F.col("id").alias("peer"), F.lit("service").alias("_kind")).unionByName(externals.select(F.col("id").alias("peer"), F.lit("external").alias("_kind"))).dropDuplicates(["peer"])
    m = methods.select(F.col("service").alias("peer"), "id", F.col("http").alias("_http")).dropDuplicates(["peer", "id"])
    j = calls.join(known, "peer", "left").join(m.withColumn("_found", F.lit(True)), ["peer", "id"], "left")
    protocol = F.when(F.col("id").startswith("soap/"), "SOAP").when(F.coalesce("_http", F.lit(False)) | F.col("id").startswith("http-client/"), "HTTP").otherwise("RPC")
    return j.groupBy("service", "peer", F.coalesce("_kind", F.lit("unresolved")).alias("kind")).agg(F.count("*").alias("operations"), F.count("_found").alias("documented"), F.array_sort(F.collect_set(protocol)).alias("protocols"))
