"""Problem rules: a typed predicate language over flat rows, compiled to Columns.

The language has ``||  &&  !  == != < <= > >=  in  + - * / %  ?:``, literals, lists, field names, and the
functions ``size``, ``matches``, ``startsWith``, ``endsWith``, ``contains``, ``string``, ``int`` and the list
macros ``exists``, ``all`` and ``filter``. Absent values are their type's zero, never null. An expression that
fails on a row (a division by zero, say) counts as no match there and doesn't end the job.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How large an expression may be.
MAX_NODES, MAX_DEPTH, MAX_LIST = 512, 32, 64
ZEROS = {"string": "", "int": 0, "bool": False, "list": []}
TOKEN = re.compile(r"\s*(?:(\d+)|(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(\|\||&&|==|!=|<=|>=|[-+*/%!<>?:().,\[\]]))")


class RuleError(ValueError):
    """An expression that can't be read or has the wrong types."""


@dataclass(frozen=True)
class Typed:
    column: Column
    type: str  # string, int, bool, list


class _Parser:
    def __init__(self, source: str, scope: dict[str, Typed]):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise RuleError(f"can't read {source[at : at + 20]!r}")
            self.tokens.append(next((k, v) for k, v in zip(("int", "text", "name", "mark"), m.groups()) if v is not None))
            at = m.end()
        if len(self.tokens) > MAX_NODES:
            raise RuleError(f"more than {MAX_NODES} parts")
        self.at, self.scope, self.depth = 0, scope, 0
        self.fields: set[str] = set()

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.tokens[self.at][0] != "text":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise RuleError(f"{mark!r} is missing before {self.peek()!r}")

    def whole(self) -> Typed:
        out = self.choice()
        if self.at < len(self.tokens):
            raise RuleError(f"unexpected {self.peek()!r}")
        return out

    def choice(self) -> Typed:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise RuleError(f"deeper than {MAX_DEPTH}")
        test = self.chain(("||",), lambda: self.chain(("&&",), self.compare))
        if self.take("?"):
            a = self.choice()
            self.need(":")
            b = self.choice()
            self._same("bool", test)
            self._same(a.type, b)
            test = Typed(F.when(test.column, a.column).otherwise(b.column), a.type)
        self.depth -= 1
        return test

    def _same(self, kind: str, *values: Typed) -> None:
        for v in values:
            if v.type != kind:
                raise RuleError(f"{v.type} where {kind} is needed")

    def chain(self, marks: tuple[str, ...], part) -> Typed:
        left = part()
        while mark := self.take(*marks):
            right = part()
            self._same("bool", left, right)
            left = Typed(left.column | right.column if mark == "||" else left.column & right.column, "bool")
        return left

    def compare(self) -> Typed:
        left = self.sum()
        if mark := self.take("==", "!=", "<", "<=", ">", ">="):
            right = self.sum()
            self._same(left.type, right)
            a, b = left.column, right.column
            return Typed({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[mark], "bool")
        if self.peek() == "in" and self.take("in"):
            right = self.sum()
            self._same("list", right)
            return Typed(F.array_contains(right.column, left.column), "bool")
        return left

    def sum(self) -> Typed:
        left = self.product()
        while mark := self.take("+", "-"):
            right = self.product()
            if mark == "+" and left.type == right.type == "string":
                left = Typed(F.concat(left.column, right.column), "string")
            elif mark == "+" and left.type == right.type == "list":
                left = Typed(F.concat(left.column, right.column), "list")
            else:
                self._same("int", left, right)
                left = Typed(F.try_add(left.column, right.column) if mark == "+" else F.try_subtract(left.column, right.column), "int")
        return left

    def product(self) -> Typed:
        left = self.unary()
        while mark := self.take("*", "/", "%"):
            right = self.unary()
            self._same("int", left, right)
            value = F.try_multiply(left.column, right.column) if mark == "*" else F.try_divide(left.column, right.column).cast("long") if mark == "/" else F.try_mod(left.column, right.column)
            left = Typed(value, "int")
        return left

    def unary(self) -> Typed:
        if self.take("!"):
            value = self.unary()
            self._same("bool", value)
            return Typed(~value.column, "bool")
        if self.take("-"):
            value = self.unary()
            self._same("int", value)
            return Typed(-value.column, "int")
        return self.member()

    def member(self) -> Typed:
        value = self.primary()
        while self.take("."):
            name = self.peek()
            self.at += 1
            self.need("(")
            value = self.method(value, name)
            self.need(")")
        return value

    def method(self, value: Typed, name: str | None) -> Typed:
        if name in ("exists", "all", "filter"):
            self._same("list", value)
            item = self.peek()
            self.at += 1
            self.need(",")
            here = self.at

            def body(x: Column) -> Column:
                self.at = here
                kept, self.scope = self.scope, self.scope | {item: Typed(x, "string")}
                out = self.choice()
                self._same("bool", out)
                self.scope = kept
                return out.column

            made = {"exists": F.exists, "all": F.forall, "filter": F.filter}[name](value.column, body)
            return Typed(made, "list" if name == "filter" else "bool")
        if name == "size":
            return self.size(value)
        self._same("string", value)
        arg = self.choice()
        self._same("string", arg)
        made = {"matches": F.regexp_like, "startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains}.get(name)
        if made is None:
            raise RuleError(f"no function {name!r}")
        return Typed(made(value.column, arg.column), "bool")

    @staticmethod
    def size(value: Typed) -> Typed:
        if value.type == "list":
            return Typed(F.size(value.column).cast("long"), "int")
        if value.type == "string":
            return Typed(F.length(value.column).cast("long"), "int")
        raise RuleError(f"size of {value.type}")

    def primary(self) -> Typed:
        if self.at >= len(self.tokens):
            raise RuleError("the expression ends too soon")
        kind, token = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Typed(F.lit(int(token)).cast("long"), "int")
        if kind == "text":
            return Typed(F.lit(re.sub(r"\\(.)", r"\1", token[1:-1])), "string")
        if token == "(":
            value = self.choice()
            self.need(")")
            return value
        if token == "[":
            items = []
            while not self.take("]"):
                items.append(self.choice())
                self.take(",")
            if len(items) > MAX_LIST:
                raise RuleError(f"more than {MAX_LIST} items")
            return Typed(F.array(*[x.column for x in items]) if items else F.array().cast("array<string>"), "list")
        if token in ("true", "false"):
            return Typed(F.lit(token == "true"), "bool")
        if token in ("size", "string", "int") and self.take("("):
            value = self.choice()
            self.need(")")
            if token == "size":
                return self.size(value)
            return Typed(value.column.cast("string"), "string") if token == "string" else Typed(value.column.try_cast("long"), "int")
        if kind == "name" and token in self.scope:
            self.fields.add(token)
            return self.scope[token]
        raise RuleError(f"no field {token!r}")


def scope_of(schema: T.StructType) -> dict[str, Typed]:
    """The fields of a row, with absent values as zeros; columns of other types can't be named."""
    out = {}
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out[f.name] = Typed(F.coalesce(c, F.lit("")), "string")
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = Typed(F.coalesce(c, F.lit(False)), "bool")
        elif isinstance(f.dataType, T.IntegralType):
            out[f.name] = Typed(F.coalesce(c.cast("long"), F.lit(0).cast("long")), "int")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out[f.name] = Typed(F.coalesce(c, F.array().cast("array<string>")), "list")
    return out


def compile_expression(source: str, schema: T.StructType, type: str) -> Column:
    """The Column of an expression; RuleError if it can't be read or isn't of ``type``."""
    value = _Parser(source, scope_of(schema)).whole()
    if value.type != type:
        raise RuleError(f"the expression is {value.type}, not {type}")
    return F.coalesce(value.column, F.lit(False)) if type == "bool" else value.column


def fields_of(source: str, schema: T.StructType) -> list[str]:
    parser = _Parser(source, scope_of(schema))
    parser.whole()
    return sorted(parser.fields & set(schema.names))


@dataclass(frozen=True)
class Rule:
    id: str
    over: str
    when: str
    message: str = '""'
    severity: str = "warning"
    disabled: bool = False
    reason: str = ""


def resolve_rules(builtin: list[Rule], entries: list[dict]) -> list[Rule]:
    """Built-in rules may be regraded or switched off (with a reason), not rewritten; other ids are custom rules."""
    rules = {r.id: r for r in builtin}
    for e in entries:
        if e["id"] in {r.id for r in builtin}:
            if {"when", "over", "message"} & set(e):
                raise RuleError(f"{e['id']}: a built-in rule can't be rewritten")
            if e.get("disabled") and not e.get("reason"):
                raise RuleError(f"{e['id']}: switching off needs a reason")
            rules[e["id"]] = Rule(**(rules[e["id"]].__dict__ | e))
        else:
            rules[e["id"]] = Rule(**e)
    return list(rules.values())


def evaluate(rows: DataFrame, subject: str, rules: list[Rule], ident: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All rules over one subject in one scan: (problems, failures).

    Problems: rule, severity, disabled, subject, message. Disabled rules' rows are given too, marked, so that they can be counted.
    A rule that can't be compiled is a failure (id, why) and gives no rows.
    """
    hits, failures = [], []
    for rule in (r for r in rules if r.over == subject):
        try:
            when, message = compile_expression(rule.when, rows.schema, "bool"), compile_expression(rule.message, rows.schema, "string")
        except RuleError as e:
            failures.append((rule.id, str(e)))
            continue
        hits.append(F.when(when, F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), F.lit(rule.disabled).alias("disabled"), message.alias("message"))))
    if not hits:
        empty = rows.select(F.col(ident).cast("string").alias("subject")).limit(0)
        return empty.select(*[F.lit("").alias(c) for c in ("rule", "severity")], F.lit(False).alias("disabled"), "subject", F.lit("").alias("message")), failures
    out = rows.select(F.col(ident).cast("string").alias("subject"), F.explode(F.array_compact(F.array(*hits))).alias("_p"))
    return out.select("_p.rule", "_p.severity", "_p.disabled", "subject", "_p.message"), failures


#: Longer lists aren't taken apart, but stand as a whole.
MOST_ITEMS = 64


def why(rows: DataFrame, source: str, ident: str) -> DataFrame:
    """Which fields decide the verdict of each row: (ident, matched, field, decisive, items, joint).

    Each field in turn takes another value: text and lists become empty, numbers 0, conditions the opposite; what is so already takes a value that no row
    has. The field is decisive if the verdict flips. ``items``: the elements of a list whose absence alone flips it; if there are none, those that alone keep the
    verdict; none if all would be named. ``joint``: the row matches, by several fields, and none of them decides alone. All
    variants are evaluated in one scan, by compiling the expression with that field replaced.
    """
    scope = scope_of(rows.schema)
    strings = lambda *x: F.array(*x).cast("array<string>")
    mark = F.lit("\u2063")
    other = {
        "string": lambda c: F.when(c == "", mark).otherwise(F.lit("")), "int": lambda c: F.when(c == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), "bool": lambda c: ~c,
        "list": lambda c: F.when(F.size(c) == 0, F.array(mark)).otherwise(strings()),
    }
    matched = compile_expression(source, rows.schema, "bool")

    def verdict(field: str, value: Column) -> Column:
        return _Parser(source, scope | {field: Typed(value, scope[field].type)}).whole().column

    def flips(field: str, value: Column) -> Column:
        return F.coalesce(verdict(field, value) != matched, F.lit(False))

    cells = []
    for f in fields_of(source, rows.schema):
        c = scope[f].column
        decisive = flips(f, other[scope[f].type](c))
        items = strings()
        if scope[f].type == "list":
            without = F.filter(c, lambda x, i: flips(f, F.filter(c, lambda y, j: j != i)))
            alone = F.filter(c, lambda x: F.coalesce(verdict(f, F.array(x)) == matched, F.lit(False)))
            several = F.when(F.size(without) > 0, without).when(decisive & (F.size(alone) < F.size(c)), alone).otherwise(strings())
            several = F.when(F.size(several) == F.size(c), strings()).otherwise(several)
            items = F.when((F.size(c) == 1) & decisive, c).when((F.size(c) > 1) & (F.size(c) <= MOST_ITEMS), several).otherwise(strings())
        cells.append(F.struct(F.lit(f).alias("field"), (decisive | (F.size(items) > 0)).alias("decisive"), items.alias("items")))
    found = rows.select(ident, matched.alias("matched"), F.array(*cells).alias("_c"))
    joint = F.col("matched") & (F.size("_c") > 1) & ~F.exists("_c", lambda x: x["decisive"])
    return found.select(ident, "matched", joint.alias("joint"), F.explode("_c").alias("_c")).select(ident, "matched", "_c.*", "joint")
