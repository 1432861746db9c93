"""Spliced flows, journeys, and references of specifications."""

from atlasframe.operators import flows, specs


def test_spliced_flows_and_journeys(spark):
    step = lambda f, i, a="x", b="y": (f, i, f"{f}{i}", "step", a, b)
    nodes = spark.createDataFrame([step("a", 1), step("a", 2), step("b", 1), step("b", 2, "y", "z"), step("c", 1)], "flow_id string, ord long, node_id string, type string, `from` string, `to` string")
    doors = spark.createDataFrame([("a", "a1", "b"), ("b", "b1", "c"), ("c", "c1", "a"), ("b", "b2", "b")], "flow_id string, step_id string, next_flow string")
    rows = flows.spliced(nodes, doors).where("root = 'a'").orderBy("place").collect()
    assert [(r.node_id, r.level) for r in rows] == [("a1", 0), ("b1", 1), ("c1", 2), ("b2", 1), ("a2", 0)]
    opened = spark.createDataFrame([("a1", "b")], "step_id string, next_flow string")
    journey = flows.spliced(nodes, doors, opened, depth=4)
    assert [r.node_id for r in journey.where("root = 'a'").orderBy("place").collect()] == ["a1", "b1", "b2", "a2"]
    reach = {r.root: (r.doors, r.open_doors, r.steps, r.lanes) for r in flows.journey_reach(journey, doors).collect()}
    assert reach["a"] == (3, 1, 4, 3) and reach["c"] == (1, 0, 1, 2)


def test_references(spark):
    texts = spark.createDataFrame([("s", "See `https://x.y/z`, `R1`, `T1`, `service:oms`, `service:two`, `shop.oms`, `shop.gone`, `./src/a.go:12`, `src/b.go`, `some words` and `R1`. ` pad `")], "spec string, text string")
    items = spark.createDataFrame([("s", "requirement", "R1"), ("s", "task", "T1"), ("s", "task", "R1"), ("q", "task", "Q")], "spec string, kind string, id string")
    ids = spark.createDataFrame([("shop.oms",)], "id string")
    slugs = spark.createDataFrame([("service", "oms", "shop.oms"), ("service", "two", "a.two"), ("service", "two", "b.two")], "kind string, slug string, id string")
    found = specs.references(texts, items, ids, slugs, spark.createDataFrame([("s", "src/a.go")], "spec string, path string"))
    assert {(r.raw, r.kind, r.target) for r in found.collect()} == {
        ("https://x.y/z", "url", "https://x.y/z"), ("R1", "requirement", "R1"), ("T1", "task", "T1"), ("service:oms", "typed-slug", "shop.oms"), ("service:two", "typed-slug", None), ("shop.oms", "catalog-id", "shop.oms"),
        ("shop.gone", "catalog-id", None), ("./src/a.go:12", "source", "src/a.go"), ("src/b.go", "source", None),
    }
    assert specs.unresolved(found).count() == 3
