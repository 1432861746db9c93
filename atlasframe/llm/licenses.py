"""License scans: one Aho-Corasick pass over the words, and a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasframe.llm.common import documents, slices

SCAN = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"
#: The phrases of the contract and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases that this method adds: versions, variants and sentences of well-known notices.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "apache 2 0": "apache-2.0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0-1.0",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Words before a phrase that make a notice of a mention.
GRANTS = ("licensed under", "released under", "distributed under", "available under", "terms of")
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
#: Bytes of words stay (letters in lower case), all others become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.\-]*\+?|[()]")


def postfix(expression: str) -> list[str] | None:
    """Licence expression in postfix order by a shunting-yard; None if it isn't well formed.

    Parsing ends before the first token that can't follow, so comment ends and prose after an
    expression are left out.
    """
    out, held, want_id = [], [], True
    for token in ID.findall(expression):
        low = token.lower()
        if low in PRECEDENCE:
            if want_id:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[low]:
                out.append(held.pop())
            held.append(low)
            want_id = True
        elif token == "(":
            if not want_id:
                break
            held.append(token)
        elif token == ")":
            if want_id or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            if not want_id:
                break
            out.append(low)
            want_id = False
    if want_id or "(" in held:
        return None
    return out + held[::-1]


def normal(order: list[str]) -> str:
    """A postfix expression with brackets, where the parts of ``and`` and ``or`` are each there once and sorted; nothing is multiplied out."""
    stack: list[tuple[str, frozenset[str]]] = []

    def text(operator: str, parts: frozenset[str], inside: str = "") -> str:
        joined = f" {operator} ".join(sorted(parts))
        return f"({joined})" if inside and len(parts) > 1 and inside != operator else joined

    for token in order:
        if token not in PRECEDENCE:
            stack.append(("", frozenset([token])))
        elif token == "with":
            exception, licence = stack.pop(), stack.pop()
            stack.append(("", frozenset([f"{text(*licence, token)} with {text(*exception, token)}"])))
        else:
            sides = [stack.pop(), stack.pop()]
            parts = frozenset(x for operator, own in sides for x in (own if operator in ("", token) else [text(operator, own, token)]))
            stack.append((token if len(parts) > 1 else "", parts))
    return text(*stack[0])


def permitted(order: list[str], accepted: set[str]) -> bool:
    """Can a postfix expression be met with ``accepted`` licences only? An exception only adds permissions, so the licence before ``with`` decides."""
    stack: list[bool] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append(token in accepted)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left or right if token == "or" else left and right if token == "and" else left)
    return stack[0]


def named(order: list[str]) -> set[str]:
    """The licences of a postfix expression; exceptions behind ``with`` are none."""
    stack: list[set[str]] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append({token})
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if token == "with" else left | right)
    return stack[0]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        found: dict[str, list[tuple[str, str]]] = {}
        for kind, phrases in (("base", BASE), ("notice", NOTICES), ("grant", dict.fromkeys(GRANTS, "")), ("tag", {TAG: ""})):
            for phrase, label in phrases.items():
                found.setdefault(phrase, []).append((kind, label))
        for phrase, what in found.items():
            self.machine.add_word(f" {phrase} ", (len(phrase) + 1, what))
        self.machine.make_automaton()

    def scan(self, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        base, labels, hits, grant, tag = set(), set(), [], False, False
        for end, (size, what) in self.machine.iter(line):
            for kind, label in what:
                if kind == "base":
                    hits.append(end - size)
                    base.add(label)
                elif kind == "notice":
                    labels.add(label)
                elif kind == "grant":
                    grant = True
                else:
                    tag = True
        read = []
        if tag:
            for raw in TAG_LINE.findall(text):
                order = postfix(raw)
                if order:
                    read.append(normal(order))
                    labels.update(named(order))
        labels |= base
        first = last = None
        if hits:  # blanks before a place are words before it
            first = line.count(" ", 0, min(hits))
            last = first + line.count(" ", min(hits), max(hits))
        score = 1.0 if read else (0.9 if grant else 0.6) if labels else 0.0
        return len(words), len(hits), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, read


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence phrases, labels and expressions of every text of ``docs`` (``doc_id``, ``text``).

    Words are runs of letters, digits and other non-ASCII characters, A-Z in lower case. ``n_base`` counts
    all places of the base phrases, overlapping ones too. ``expressions`` are the parsed licence tags, in normal form. ``score``:
    1 with a parsed tag, 0.9 for labels with words of a grant, 0.6 for other labels, else 0. Null text counts as empty:
    no words, empty labels, null places. Very long texts are read whole, in time linear in their length. One row per input row, repeated rows and rows without id too; an empty table
    gives no rows; no shuffle; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string())]
        for batch in slices(batches):
            rows = [scanner.scan(x or "") for x in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[f.split()[0] for f in SCAN.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("expressions")
