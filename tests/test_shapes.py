"""Type spellings, shapes and paths, method families, integrations."""

from pyspark.sql import functions as F

from atlasframe.operators import shapes


def test_type_parts(spark):
    want = {
        "string": ("string", False, False), "[]Line": ("Line", True, False), "Option<Vec<Line>>": ("Line", True, True), "repeated Line": ("Line", True, False), "T | null": ("T", False, True), "*Money": ("Money", False, True),
        "List<Line?>": ("Line", True, True), "optional repeated X": ("X", True, True), "Map<K,V>": ("V", True, False), "map<string, Money>": ("Money", True, False),
        "Box<Money>": ("Money", False, False), "VecDeque<Money>": ("Money", True, False), "DateTime<Utc>": ("DateTime<Utc>", False, False), "Option<Box<Vec<Arc<Option<HashMap<String, Vec<Line>>>>>>>": ("Line", True, True), "[]" * 12 + "Line": ("Line", True, False), "": ("", False, False),
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: tuple(r.p)[:3] for r in df.select("t", shapes.type_parts(F.col("t")).alias("p")).collect()} == want
    keyed = {"Map<K,V>": True, "Vec<Map<K,V>>": False, "Map<K,Vec<V>>": True, "[]V": False}
    df = spark.createDataFrame([(k,) for k in keyed], "t string")
    assert {r.t: r.p.by_key for r in df.select("t", shapes.type_parts(F.col("t")).alias("p")).collect()} == keyed
    assert spark.createDataFrame([(None,)], "t string").select(shapes.type_parts(F.col("t")).alias("p")).first().p is None


def test_types_disagree(spark):
    rows = [("varchar(10)", "string", False), ("bigint", "int", False), ("text", "int", True), ("numeric(10,2)", "decimal.Decimal", False), ("jsonb", "string", True), ("whatever", "string", False), ("TIMESTAMP  WITH TIME ZONE", "time.Time", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(shapes.types_disagree(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_shapes_and_paths(spark):
    blocks = spark.createDataFrame([("b1", "Line", "a1", "s"), ("b2", "Line", "a2", "s"), ("b3", "Far", "a3", "other")], "id string, name string, aggregate string, service string")
    enums = spark.createDataFrame([("e1", "Line", "a1", "s"), ("e2", "Kind", "a2", "s")], "id string, name string, aggregate string, service string")
    fields = spark.createDataFrame([("f1", "[]Line", None, "a1", "s"), ("f2", "Kind", None, "a1", "s"), ("f3", "Far", None, "a1", "s"), ("f4", "Line", "d", "a1", "s"), ("f5", "string", "nope", "a1", "s")], "field_id string, type string, ref string, aggregate string, service string")
    got = {r.field_id: (r.kind, r["shape"]) for r in shapes.resolve_shapes(fields, spark.createDataFrame([("d",)], "def_id string"), blocks, enums).collect()}
    assert got == {"f1": ("block", "b1"), "f2": ("enum", "e2"), "f3": (None, None), "f4": ("def", "d"), "f5": (None, None)}
    edges = spark.createDataFrame([("A", "b", "B"), ("B", "a", "A"), ("B", "c", "C"), ("C", "x", None)], "shape string, name string, target string")
    paths = shapes.openable_paths(spark.createDataFrame([("m", "A")], "root string, shape string"), edges)
    assert {(r.path, r["shape"], r.depth) for r in paths.collect()} == {("b", "B", 1), ("b.c", "C", 2)}


def test_families_and_integrations(spark):
    methods = spark.createDataFrame([("i", f"m{k}", f"/api/v1/{'orders' if k < 12 else 'items' if k < 21 else 'odd'}/{{id}}") for k in range(22)] + [("j", "n", "/orders")], "interface string, name string, path string")
    got = {(r.interface, r.name): r.family for r in shapes.method_groups(methods).collect()}
    assert (got["i", "m0"], got["i", "m20"], got["i", "m21"], got["j", "n"]) == ("orders", "items", None, None)
    calls = spark.createDataFrame([("s", "p", "A/x"), ("s", "p", "A/y"), ("s", "e", "http-client/z"), ("s", "?", "B/q")], "service string, peer string, id string")
    served = spark.createDataFrame([("p", "A/x", True)], "service string, id string, http boolean")
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    assert {(r.peer, r.kind, r.operations, r.documented, tuple(r.protocols)) for r in shapes.integrations(calls, served, one("p"), one("e")).collect()} == {("p", "service", 2, 1, ("HTTP", "RPC")), ("e", "external", 1, 0, ("HTTP",)), ("?", "unresolved", 1, 0, ("RPC",))}
