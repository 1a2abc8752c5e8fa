"""JSON Schema over values, recursive schemas included.

A schema without recursion is one expression over the value (``functions.jsonx.schema_errors``). Where a reference
leads back to itself, the depth of the checks is that of the data. Then each value is taken apart level by level
within its own row, without a shuffle or a scratch table: the nodes of a level are an array, and each says under which
schemas it is put. The schemas are evaluated from the deepest level up: what a node's children have come to is a slice
of the array of the level below. Only what a recursive schema is put to becomes a node; a schema below a node that
does not lead back to itself is part of the node's own rules. The plan depends on the schema alone, the number of
levels on the data.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J

ERRORS = "array<array<string>>"
#: A value, the schemas it is put under by number, and its parent's place in the level above.
NODE = "struct<parent:int,under:array<int>,v:variant>"
#: What a level has come to: the errors of each node under each schema.
CHECKED = f"array<struct<parent:int,errors:{ERRORS}>>"


class _Nodes(J.Expression):
    """Below a node stand its children, each with its errors under each of the recursive schemas, by number."""

    def __init__(self, root: Any) -> None:
        super().__init__(root)
        self.schemas: list[Any] = [root]
        #: Schema, step to a child (* for any), the schema that is put to the child.
        self.steps: list[tuple[int, str, int]] = []
        self.current = 0

    def number(self, schema: Any) -> int:
        for i, s in enumerate(self.schemas):
            if s is schema:
                return i
        self.schemas.append(schema)
        return len(self.schemas) - 1

    def fields(self, x: Column) -> Column:
        return x["named"]

    def elements(self, x: Column) -> Column:
        return x["listed"]

    def errors(self, child: Column, schema: Any, path: str, name: str, via: tuple[str, ...]) -> Column:
        """The child's errors; under a recursive schema their paths begin at the child, and the step to it is put in front."""
        try:
            return J._errors(child["v"], schema, f"{path}/{name}", J.Expression(self.root), via)
        except J.RecursiveSchema:
            pass
        k = self.number(schema)
        if (step := (self.current, name, k)) not in self.steps:
            self.steps.append(step)
        below = lambda e: F.concat(F.lit(f"{path}/{name}"), F.when(F.startswith(e, F.lit("/ ")), F.substr(e, F.lit(2))).otherwise(e))
        return F.transform(F.get(child["errors"], F.lit(k)), below)

    def rules(self, node: Column, below: Column) -> Column:
        """The errors of a node under every schema that it is put under, null for the others. below: its children as
        ``CHECKED``, in the order of ``children``, or none."""

        def full(o: Column) -> Column:
            found = lambda i: F.get(below, i)["errors"]
            values = F.transform(F.map_values(o["fields"]), lambda v, i: F.struct(v.alias("v"), found(i).alias("errors")))
            named = F.coalesce(F.map_from_arrays(F.map_keys(o["fields"]), values), F.create_map().cast(f"map<string,struct<v:variant,errors:{ERRORS}>>"))
            listed = F.coalesce(F.transform(o["elements"], lambda v, i: F.struct(v.alias("v"), found(i).alias("errors"))), F.array().cast(f"array<struct<v:variant,errors:{ERRORS}>>"))
            return F.struct(*[o[c].alias(c) for c in ("v", "fields", "elements", "kind")], named.alias("named"), listed.alias("listed"))

        def each(x: Column) -> Column:
            out: list[Column] = []
            while len(out) < len(self.schemas):
                self.current = len(out)
                found = J._rules(x, self.schemas[self.current], "", self, ())
                out.append(F.when(F.array_contains(node["under"], self.current), found))
            return F.array(*out)

        return F.when(F.size(node["under"]) > 0, J._opened(node["v"], lambda o: J._let(full(o), each)))

    def children(self, node: Column, at: Column) -> Column:
        """The children of a node at that place of its level: all of them if a schema is put to any, otherwise none.
        Those that no schema is put to have no value."""

        none = F.array().cast(f"array<{NODE}>")
        put = lambda step: F.array_compact(F.array(*[F.when(F.array_contains(node["under"], k) & (F.lit(name == "*") | (step == name)), to) for k, name, to in self.steps]).cast("array<int>"))
        child = lambda v, step: J._let(put(step), lambda u: F.struct(at.alias("parent"), u.alias("under"), F.when(F.size(u) > 0, v).alias("v")))
        fields = F.transform(F.map_entries(J._fields(node["v"])), lambda e: child(e["value"], e["key"]))
        elements = F.transform(J._elements(node["v"]), lambda v, i: child(v, i.cast("string")))
        used = lambda c: F.when(F.exists(c, lambda n: F.size(n["under"]) > 0), c).otherwise(none)
        return F.when(F.size(node["under"]) > 0, J._let(F.coalesce(fields, elements, none), used)).otherwise(none)


def _levels(v: Column, nodes: _Nodes) -> Column:
    """The levels of a value's nodes, the root's first. There are at most as many as the value has brackets that open."""
    root = F.array(F.struct(F.lit(0).alias("parent"), F.array(F.lit(0)).alias("under"), v.alias("v")).cast(NODE))
    text = F.to_json(v)
    brackets = F.length(text) - F.length(F.translate(text, "[{", ""))

    # Not bound to a variable on the way, which would copy all levels so far.
    down = lambda acc, _: F.when(F.size(acc["last"]) == 0, acc).otherwise(F.struct(F.concat(acc["all"], F.array(acc["last"])).alias("all"), F.flatten(F.transform(acc["last"], nodes.children)).alias("last")))
    start = F.struct(F.array().cast(f"array<array<{NODE}>>").alias("all"), root.alias("last"))
    steps = F.when(brackets > 0, F.sequence(F.lit(1), brackets)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, down, lambda acc: F.when(F.size(acc["last"]) == 0, acc["all"]).otherwise(F.concat(acc["all"], F.array(acc["last"]))))


def _checked(level: Column, below: Column, nodes: _Nodes) -> Column:
    """What a level's nodes have come to. The children of a node stand side by side in the level below, in the order of
    their parents, so that their first one tells the slice."""
    firsts = F.filter(F.transform(below, lambda c, i: F.when((i == 0) | (c["parent"] != F.get(below, i - 1)["parent"]), i)), lambda i: i.isNotNull())
    place = lambda node, start, n: F.struct(node.alias("node"), start.alias("start"), n.alias("n"))

    def spread(starts: Column) -> Column:
        """For each node the place of its first child and how many there are."""
        some = F.transform(starts, lambda s, j: place(F.get(below, s)["parent"], s, F.coalesce(F.get(starts, j + 1), F.size(below)) - s))
        # What stands for no children sorts behind a node's children, and is dropped there.
        every = F.transform(level, lambda _, i: place(i, F.lit(1 << 30), F.lit(0)))
        return J._let(F.sort_array(F.concat(some, every)), lambda b: F.filter(b, lambda e, i: (i == 0) | (e["node"] != F.get(b, i - 1)["node"])))

    # A level of one node has all that is below; one above nothing has nothing.
    single = F.transform(level, lambda _, i: place(i, F.lit(0), F.size(below)))
    places = F.when((F.size(level) == 1) | (F.size(below) == 0), single).otherwise(J._let(firsts, spread))
    checked = lambda n, own: F.struct(n["parent"].alias("parent"), nodes.rules(n, own).alias("errors"))
    slices = lambda at, i: F.slice(below, F.get(at, i)["start"] + 1, F.get(at, i)["n"])
    return J._let(places, lambda at: F.transform(level, lambda n, i: J._let(slices(at, i), lambda own: checked(n, own))))


def _recursive_errors(v: Column, schema: dict[str, Any] | bool) -> Column:
    nodes = _Nodes(schema)
    # The rules say which schema is put where, which the way down has to know: they are built first, and again in place.
    nodes.rules(F.struct(v.alias("v"), F.array(F.lit(0)).alias("under")), F.array().cast(CHECKED))
    up = lambda levels: F.aggregate(F.reverse(levels), F.array().cast(CHECKED), lambda below, level: _checked(level, below, nodes))
    return J._let(_levels(v, nodes), lambda levels: F.get(F.get(up(levels), F.lit(0))["errors"], F.lit(0)))


def with_schema_errors(items: DataFrame, value: str, schema: dict[str, Any] | bool, name: str = "errors") -> DataFrame:
    """items with each value's errors, an array of 'path keyword'; null where there is no value."""
    v = F.col(value)
    try:
        errors = J.schema_errors(v, schema)
    except J.RecursiveSchema:
        errors = _recursive_errors(v, schema)
    return items.withColumn(name, F.when(v.isNotNull(), errors))
