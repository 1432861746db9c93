"""Ways through flows by counting: how many there are, the one of a rank, and the rank of one, without listing them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Ways:
    """The ways through one flow (a list of nodes): only an ``alt`` forks, a loop's body and all parallel branches are taken, and a terminal branch ends the way.

    Each frame has a number of ways that go on behind it and one of ways that end in it; a list's numbers are products and sums of its nodes'. Ways are in the order of
    a walk that takes the branches of the first choice one after the other, for each of them those of the next choice, and so on.
    """

    def __init__(self, nodes: list[dict]):
        self.nodes = nodes
        self.known: dict[int, tuple[int, int]] = {}

    @staticmethod
    def inner(node: dict) -> list[dict]:
        """What a frame that doesn't fork has in it, one after the other."""
        return node["steps"] if node["type"] == "loop" else [x for branch in node["branches"] for x in branch]

    def numbers(self, node: dict) -> tuple[int, int]:
        """(ways that go on, ways that end) of a node."""
        if node["type"] == "step":
            return 1, 0
        if id(node) not in self.known:
            if node["type"] == "alt":
                on = end = 0
                for branch in node["branches"]:
                    a, b = self.of_list(branch["steps"])
                    on, end = (on, end + a + b) if branch.get("terminal") else (on + a, end + b)
                self.known[id(node)] = on, end
            else:
                self.known[id(node)] = self.of_list(self.inner(node))
        return self.known[id(node)]

    def of_list(self, nodes: list[dict]) -> tuple[int, int]:
        on, end = 1, 0
        for node in nodes:
            a, b = self.numbers(node)
            on, end = on * a, end + on * b
        return on, end

    def total(self) -> int:
        return sum(self.of_list(self.nodes))

    def walk(self, choose) -> tuple[list[tuple[str, int]], list[str], bool] | None:
        """Choices, steps and whether the way ends in a terminal branch; ``choose`` picks a branch by (frame, sizes). None where it picks none."""
        todo, choices, steps, ended = list(reversed(self.nodes)), [], [], False
        while todo:
            node = todo.pop()
            if node["type"] == "step":
                steps.append(node["id"])
            elif node["type"] != "alt":
                todo += reversed(self.inner(node))
            else:
                rest = sum(self.of_list(todo[::-1]))
                sizes = [a + b if branch.get("terminal") else a * rest + b for branch in node["branches"] for a, b in [self.of_list(branch["steps"])]]
                k = choose(node, sizes)
                if k is None:
                    return None
                choices.append((node["id"], k))
                if node["branches"][k].get("terminal"):
                    ended, todo = True, []
                todo += reversed(node["branches"][k]["steps"])
        return choices, steps, ended

    def at(self, rank: int) -> tuple[list[tuple[str, int]], list[str], bool] | None:
        """The way of a rank (from 0); None if there are not so many."""
        if not 0 <= rank < self.total():
            return None
        left = rank

        def choose(node: dict, sizes: list[int]) -> int | None:
            nonlocal left
            for k, size in enumerate(sizes):
                if left < size:
                    return k
                left -= size
            return None

        return self.walk(choose)

    def rank(self, choices: list[tuple[str, int]]) -> int | None:
        """The rank of the way with these choices, which must be all of its choices in order; else None."""
        left, before = list(choices), 0

        def choose(node: dict, sizes: list[int]) -> int | None:
            nonlocal before
            if not left or left[0][0] != node["id"] or not 0 <= left[0][1] < len(sizes):
                return None
            k = left.pop(0)[1]
            before += sum(sizes[:k])
            return k

        return before if self.walk(choose) is not None and not left else None


def way_name(choices: list[tuple[str, int]]) -> str:
    """A way's name: its choices as ``frame:branch``, in order."""
    return "|".join(f"{frame}:{k}" for frame, k in choices)


def _of_list(nodes: list[dict]) -> tuple[int, int]:
    """``Ways.of_list`` for one pass over a tree: nothing is kept, as no node is asked for twice."""
    on, end = 1, 0
    for node in nodes:
        if node["type"] == "step":
            continue
        if node["type"] == "alt":
            a = b = 0
            for branch in node["branches"]:
                x, y = _of_list(branch["steps"])
                a, b = (a, b + x + y) if branch.get("terminal") else (a + x, b + y)
        else:
            a, b = _of_list(Ways.inner(node))
        on, end = on * a, end + on * b
    return on, end


@lru_cache(maxsize=1 << 14)
def _count(steps: str) -> tuple[str, str]:
    """Digits of all ways of a flow and of those that end; flows that are told alike are counted once while they are at hand."""
    on, end = _of_list(json.loads(steps))
    return str(on + end), str(end)


def way_counts(flows: DataFrame) -> DataFrame:
    """How many ways lead through each flow (``id``, ``steps``: JSON text): flow_id, ways, ending (in a terminal branch), as decimal digits, as there may be more than a number holds.

    A flow without steps, or null, has one way; a choice without branches has none. One row in, one out; no way is listed.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_count(x if isinstance(x, str) else "[]") for x in pdf["steps"]]
            yield pd.DataFrame({"flow_id": pdf["id"], "ways": [x[0] for x in found], "ending": [x[1] for x in found]})

    return flows.select("id", "steps").mapInPandas(count, "flow_id string, ways string, ending string")


def ways_of(flows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ways of flows: by rank (``way``, digits, from 0), or by name where there is no rank (see ``way_name``): flow_id, way, name, steps, ending.

    ``flows``: id, steps (JSON text); ``wanted``: flow_id, way, name. Each asked way costs the length of the flow times its choices, however many ways there are. A rank or name that a flow hasn't
    gives null name or rank and no steps; flows that aren't known give no row. Rows of ``wanted`` that are the same are answered each.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for flow, steps, way, name in zip(pdf["flow_id"], pdf["steps"], pdf["way"], pdf["name"]):
                ways = Ways(json.loads(steps) if isinstance(steps, str) else [])
                if isinstance(way, str):
                    rank = int(way) if way.isdigit() else None
                else:
                    parts = [x.rpartition(":") for x in name.split("|")] if isinstance(name, str) and name else []
                    rank = ways.rank([(a, int(k)) for a, _, k in parts]) if isinstance(name, str) and all(k.isdigit() for _, _, k in parts) else None
                found = ways.at(rank) if rank is not None else None
                out.append((flow, str(rank) if found else way, way_name(found[0]) if found else name if not isinstance(way, str) else None, found[1] if found else None, found[2] if found else None))
            yield pd.DataFrame(out, columns=["flow_id", "way", "name", "steps", "ending"])

    asked = wanted.select("flow_id", F.col("way").cast("string").alias("way"), "name").join(flows.select(F.col("id").alias("flow_id"), "steps"), "flow_id")
    return asked.select("flow_id", "steps", "way", "name").mapInPandas(find, "flow_id string, way string, name string, steps array<string>, ending boolean")
