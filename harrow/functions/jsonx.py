"""Semi-structured values: canonical form, hashes, keys, null rates and JSON Schema, over VARIANT.

A value is taken apart once: its kind, its fields as a map and its elements as an array are bound to a lambda's
variable (``_opened``), and every rule reads them from there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ERRORS = "array<string>"
#: Strings, numbers, and what lies between them, of JSON without blanks.
TOKENS = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def one_value(text: Column) -> Column:
    """Whether nothing follows the text's first JSON value. Spark's parsers read up to its end only, so the text is read
    as the only element of an array and as the only field of an object: a bracket that closes the one too early is
    an error in the other."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return alone & F.coalesce(F.size(F.json_object_keys(F.concat(F.lit('{"a":'), text, F.lit("}")))) == 1, F.lit(False))


def variant(text: Column) -> Column:
    """Parsed JSON, or null where the text is not one value from end to end. The last of equal keys counts; Spark has
    a setting of the session for that, which is put on here and stays on, as it is read when the plan is made."""
    if (spark := SparkSession.getActiveSession()) is not None:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return F.when(one_value(text), F.try_parse_json(text))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once: the last step of an aggregate over nothing. The element of an array of one
    that is transformed would be the same, but is copied, and its type is made anew for every value."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, use)


def number_text(token: Column) -> Column:
    """A JSON number in its shortest form: no sign on zero, no point in a whole number, an exponent from 1e21 on and
    below 1e-6. Numbers are double precision; beyond that range they are null."""

    def shown(d: Column) -> Column:
        s = F.abs(d).cast("string")
        mantissa, exponent = F.split_part(s, F.lit("E"), F.lit(1)), F.coalesce(F.nullif(F.split_part(s, F.lit("E"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
        whole, rest = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
        digits = F.concat(whole, rest)
        zeros = F.length(digits) - F.length(F.ltrim(digits, F.lit("0")))
        # The value is 0.<plain> times ten to the power of place.
        parts = F.struct(F.rtrim(F.ltrim(digits, F.lit("0")), F.lit("0")).alias("plain"), (F.length(whole) + exponent - zeros).alias("place"), F.when(d < 0, "-").otherwise("").alias("sign"))

        def laid_out(p: Column) -> Column:
            plain, place = p["plain"], p["place"]
            n, power = F.length(plain), place - 1
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -place), plain)
            inner = F.concat(F.substring(plain, F.lit(1), place), F.lit("."), F.substring(plain, place + 1, n))
            head = F.when(n > 1, F.concat(F.substring(plain, 1, 1), F.lit("."), F.substring(plain, F.lit(2), n))).otherwise(plain)
            far = F.concat(head, F.lit("e"), F.when(power >= 0, "+").otherwise("-"), F.abs(power).cast("string"))
            text = F.when((place >= n) & (place <= 21), F.concat(plain, F.repeat(F.lit("0"), place - n))).when((place > 0) & (place <= 21), inner).when((place > -6) & (place <= 0), small).otherwise(far)
            return F.concat(p["sign"], text)

        return F.when(d == 0, "0").when(F.abs(d) == math.inf, "null").otherwise(_let(parts, laid_out))

    plain = token.rlike("^-?[1-9][0-9]{0,14}$")
    return F.when(plain, token).otherwise(_let(token.cast("double"), shown))


def canonical(v: Column) -> Column:
    """JSON without blanks, with sorted object keys and numbers in their shortest form; arrays keep their order."""
    fixed = lambda t: F.when(t.rlike("^-?[0-9]"), number_text(t)).otherwise(t)
    respelt = lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(TOKENS), F.lit(0)), fixed), "")
    # Most values have whole numbers of few digits only and are left as they are.
    return _let(F.to_json(v), lambda s: F.when(s.rlike(r"[0-9][.eE]|-0|[0-9]{16}"), respelt(s)).otherwise(s))


def content_hash(v: Column) -> Column:
    return F.sha2(canonical(v), 256)


def _fields(v: Column) -> Column:
    """The fields of an object; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _kind(v: Column, fields: Column, elements: Column) -> Column:
    """Only scalars are asked for their schema: that of an object would be made for all that is in it."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull(), None).when(F.is_variant_null(v), "null").when(fields.isNotNull(), "object").when(elements.isNotNull(), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").otherwise("number")


def kind_of(v: Column) -> Column:
    """object, array, string, number, boolean or null; null where the value is absent."""
    return _let(F.struct(_fields(v).alias("f"), _elements(v).alias("e")), lambda x: _kind(v, x["f"], x["e"]))


def _opened(v: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x: v, fields, elements, kind."""
    full = lambda x: F.struct(v.alias("v"), x["f"].alias("fields"), x["e"].alias("elements"), _kind(v, x["f"], x["e"]).alias("kind"))
    return _let(F.struct(_fields(v).alias("f"), _elements(v).alias("e")), lambda x: _let(full(x), use))


def field(v: Column, name: str) -> Column:
    """A field of an object, whatever signs its name has."""
    return F.element_at(_fields(v), F.lit(name))


def external_key(v: Column, names: tuple[str, ...] = ("externalKey", "id", "key")) -> Column:
    """The first of the fields that is a non-empty string or a number, as text."""

    def first(fields: Column) -> Column:
        out = []
        for n in names:
            x = F.element_at(fields, F.lit(n))
            text, kind = F.try_variant_get(x, "$", "string"), F.schema_of_variant(x)
            number = ~kind.isin("STRING", "BOOLEAN", "VOID") & ~F.startswith(kind, F.lit("OBJECT")) & ~F.startswith(kind, F.lit("ARRAY"))
            out.append(F.when((kind == "STRING") & (text != ""), text).when(number, number_text(text)))
        return F.coalesce(*out)

    return _let(_fields(v), first)


def null_rates(items: DataFrame, group: list[str], value: str, required: list[str]) -> DataFrame:
    """group, field, rate: the share of items where the field is null or absent, for all fields that occur in
    the group and the required ones. Each value is opened once, into its fields."""
    total = items.groupBy(*group).agg(F.count("*").alias("n"))
    present = items.select(*group, F.explode(_fields(F.col(value))).alias("field", "x"))
    seen = present.groupBy(*group, "field").agg(F.sum(F.when(F.is_variant_null("x"), 0).otherwise(1)).alias("present"))
    wanted = total.select(*group, F.explode(F.array(*[F.lit(r) for r in required])).alias("field")).unionByName(seen.select(*group, "field")).distinct()
    j = wanted.join(seen, [*group, "field"], "left").join(total, group)
    return j.select(*group, "field", F.round(1 - F.coalesce("present", F.lit(0)) / F.col("n"), 6).alias("rate"))


def json_text(value: Any) -> str:
    """The canonical text of a constant of a schema."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{json_text(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(json_text, value)) + "]"
    if isinstance(value, float) and value == int(value) and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, float):
        return repr(value).replace("e-0", "e-")
    return json.dumps(value, ensure_ascii=False)


#: Keywords of JSON Schema that assert something we do not build; they raise rather than let a bad value pass.
UNSUPPORTED = ("$dynamicRef", "$recursiveRef", "unevaluatedItems")


class RecursiveSchema(ValueError):
    """A reference leads back to itself: such schemas are evaluated over nodes (``operators.schema``)."""


class Expression:
    """How the rules reach what lies below a value: as an expression within that of the value itself."""

    def __init__(self, root: Any) -> None:
        self.root = root

    def fields(self, x: Column) -> Column:
        """What stands for the values of an object's fields, by name."""
        return F.coalesce(x["fields"], F.create_map().cast("map<string,variant>"))

    def elements(self, x: Column) -> Column:
        return F.coalesce(x["elements"], F.array().cast("array<variant>"))

    def errors(self, child: Column, schema: Any, path: str, name: str, via: tuple[str, ...]) -> Column:
        """The errors of what fields() or elements() stand for; name: the field's, or * where the data decide."""
        return _errors(child, schema, f"{path}/{name}", self, via)


def schema_errors(v: Column, schema: dict[str, Any] | bool, path: str = "") -> Column:
    """Errors of a value under a JSON Schema, as an array of 'path keyword'. Keywords that only annotate, formats and
    keywords of no draft are passed over; those of UNSUPPORTED raise, as do recursive references (RecursiveSchema)."""
    return _errors(v, schema, path, Expression(schema), ())


def _errors(v: Column, schema: dict[str, Any] | bool, path: str, below: Expression, via: tuple[str, ...]) -> Column:
    if isinstance(schema, bool):
        return F.array().cast(NO_ERRORS) if schema else F.array(F.lit(f"{path or '/'} false"))
    return F.when(v.isNull(), F.array().cast(NO_ERRORS)).otherwise(_opened(v, lambda x: _rules(x, schema, path, below, via)))


def _target(root: Any, ref: str) -> Any:
    if not ref.startswith("#") or (ref[1:] and not ref.startswith("#/")):
        raise ValueError(f"reference not supported: {ref}")
    for step in [s.replace("~1", "/").replace("~0", "~") for s in ref[1:].split("/") if s]:
        root = root[int(step) if isinstance(root, list) else step]
    return root


def _rules(x: Column, schema: dict[str, Any] | bool, path: str, below: Expression, via: tuple[str, ...]) -> Column:
    """The errors of an opened value (v, fields, elements, kind)."""
    here, none = path or "/", F.array().cast(NO_ERRORS)
    if isinstance(schema, bool):
        return none if schema else F.array(F.lit(f"{here} false"))
    if bad := [w for w in UNSUPPORTED if w in schema]:
        raise ValueError(f"keyword not supported: {bad[0]}")
    kind, found, out = x["kind"], [], []
    add = lambda bad, word: found.append(F.when(bad, F.lit(f"{here} {word}")))
    same = lambda s: _rules(x, s, path, below, via)
    holds = lambda s: F.size(same(s)) == 0
    has = lambda name: (kind == "object") & F.map_contains_key(x["fields"], F.lit(name))
    child = lambda c, s, name="*": below.errors(c, s, path, name, via)
    number, text = F.try_variant_get(x["v"], "$", "double"), F.try_variant_get(x["v"], "$", "string")
    types = schema.get("type")
    if types is not None:
        ok = F.lit(False)
        for t in [types] if isinstance(types, str) else types:
            ok |= (kind == "number") & (number == F.floor(number)) if t == "integer" else kind == t
        add(~ok, "type")
    if "enum" in schema:
        add(~canonical(x["v"]).isin([json_text(c) for c in schema["enum"]]), "enum")
    if "const" in schema:
        add(canonical(x["v"]) != json_text(schema["const"]), "const")
    size, names = F.size(x["elements"]), F.map_keys(x["fields"])
    for word, limit in schema.items():
        if word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") and not isinstance(limit, bool):
            bad = {"minimum": number < limit, "maximum": number > limit, "exclusiveMinimum": number <= limit, "exclusiveMaximum": number >= limit}[word]
            add((kind == "number") & bad, word)
        elif word == "multipleOf":
            add((kind == "number") & (F.abs(number / limit - F.round(number / limit)) > 1e-9), word)
        elif word in ("minLength", "maxLength"):
            add((kind == "string") & (F.length(text) < limit if word == "minLength" else F.length(text) > limit), word)
        elif word == "pattern":
            add((kind == "string") & ~text.rlike(limit), word)
        elif word in ("minItems", "maxItems"):
            add((kind == "array") & (size < limit if word == "minItems" else size > limit), word)
        elif word == "uniqueItems" and limit:
            add((kind == "array") & (F.size(F.array_distinct(F.transform(x["elements"], canonical))) < size), word)
        elif word in ("minProperties", "maxProperties"):
            add((kind == "object") & (F.size(x["fields"]) < limit if word == "minProperties" else F.size(x["fields"]) > limit), word)
        elif word == "contains":
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            n = F.size(F.filter(below.elements(x), lambda e: F.size(child(e, limit)) == 0))  # noqa: B023
            add((kind == "array") & (n < least), word)
            if most is not None:
                add((kind == "array") & (n > most), "maxContains")
        elif word == "anyOf":
            add(~_any([holds(s) for s in limit]), word)
        elif word == "oneOf":
            add(sum([holds(s).cast("int") for s in limit], F.lit(0)) != 1, word)
        elif word == "not":
            add(holds(limit), word)
        elif word == "allOf":
            out += [same(s) for s in limit]
        elif word == "if":
            then, other = (same(schema[k]) if k in schema else none for k in ("then", "else"))
            out.append(F.when(holds(limit), then).otherwise(other))
        elif word == "propertyNames":
            bad = F.filter(names, lambda n: F.size(_errors(_string(n), limit, "", Expression(below.root), via)) > 0)  # noqa: B023
            out.append(F.transform(F.sort_array(bad), lambda n: F.concat(F.lit(f"{here} propertyNames "), n)))
        elif word in ("dependentRequired", "dependentSchemas", "dependencies"):
            for name, need in limit.items():
                if isinstance(need, list):
                    for other in need:
                        add(has(name) & ~has(other), f"{word} {name} {other}")
                else:
                    out.append(F.when(has(name), same(need)).otherwise(none))
        elif word == "$ref":
            if limit in via:
                raise RecursiveSchema(f"recursive reference: {limit}")
            out.append(_rules(x, _target(below.root, limit), path, below, (*via, limit)))
    for name in schema.get("required", []):
        add((kind == "object") & ~F.map_contains_key(x["fields"], F.lit(name)), f"required {name}")
    properties, patterns, more = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties")
    known = lambda n: _any([n.isin(*properties) if properties else F.lit(False), *[n.rlike(p) for p in patterns]])
    fields = below.fields(x)
    rest = lambda taken, s, word: F.transform(F.sort_array(F.filter(F.map_keys(fields), lambda n: ~taken(n))), lambda n: F.concat(F.lit(f"{here} {word} "), n)) if s is False else F.flatten(F.transform(F.map_entries(F.map_filter(fields, lambda n, _: ~taken(n))), lambda e: child(e["value"], s)))
    if more is not None and more is not True:
        out.append(rest(known, more, "additional"))
    for name, sub in properties.items():
        c = F.element_at(fields, F.lit(name))
        out.append(F.when(c.isNotNull(), child(c, sub, name)).otherwise(none))
    for pattern, sub in patterns.items():
        out.append(F.flatten(F.transform(F.map_entries(F.map_filter(fields, lambda n, _: n.rlike(pattern))), lambda e: child(e["value"], sub))))  # noqa: B023
    if (last := schema.get("unevaluatedProperties")) is not None and last is not True:
        taken = _evaluated(x, schema, path, below, via)
        out.append(F.flatten(F.transform(F.array(taken), lambda t: rest(lambda n: F.array_contains(t, n), last, "unevaluated"))))
    items, each = schema.get("items"), below.elements(x)
    first = schema.get("prefixItems") or (items if isinstance(items, list) else [])
    others = schema.get("additionalItems") if isinstance(items, list) else items
    for k, sub in enumerate(first):
        out.append(F.when(F.size(each) > k, child(F.get(each, F.lit(k)), sub, str(k))).otherwise(none))
    if others is not None:
        tail = F.slice(each, len(first) + 1, F.greatest(F.size(each), F.lit(1))) if first else each
        out.append(F.flatten(F.transform(tail, lambda e: child(e, others))))
    out = [F.array_compact(F.array(*found))] * bool(found) + out
    # Not concat, which is slow outside of generated code.
    return F.flatten(F.array(*[F.coalesce(o, none) for o in out])) if len(out) > 1 else F.coalesce(out[0], none) if out else none


def _string(name: Column) -> Column:
    """A string as a variant."""
    return F.try_parse_json(F.regexp_replace(F.to_json(F.struct(name.alias("n"))), r'(?s)^\{"n":(.*)\}$', "$1"))


def _evaluated(x: Column, schema: Any, path: str, below: Expression, via: tuple[str, ...]) -> Column:
    """The names of an object's fields that the schema, or a schema of the same value that holds, looks at."""
    none = F.array().cast("array<string>")
    if not isinstance(schema, dict):
        return none
    names, parts = F.coalesce(F.map_keys(x["fields"]), none), [none]
    inner = lambda s: _evaluated(x, s, path, below, via)
    when = lambda s: F.when(F.size(_rules(x, s, path, below, via)) == 0, inner(s)).otherwise(none)
    if "additionalProperties" in schema:
        parts.append(names)
    if schema.get("properties"):
        parts.append(F.array(*map(F.lit, schema["properties"])))
    parts += [F.filter(names, lambda n: n.rlike(p)) for p in schema.get("patternProperties", {})]  # noqa: B023
    parts += [inner(s) for s in schema.get("allOf", [])]
    parts += [when(s) for word in ("anyOf", "oneOf") for s in schema.get(word, [])]
    if "if" in schema:
        then, other = inner(schema.get("then")), inner(schema.get("else"))
        parts.append(F.when(F.size(_rules(x, schema["if"], path, below, via)) == 0, F.concat(inner(schema["if"]), then)).otherwise(other))
    parts += [F.when(F.array_contains(names, name), inner(s)).otherwise(none) for word in ("dependentSchemas", "dependencies") for name, s in schema.get(word, {}).items()]
    if (ref := schema.get("$ref")) and ref not in via:
        parts.append(_evaluated(x, _target(below.root, ref), path, below, (*via, ref)))
    return F.concat(*parts)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def is_valid(v: Column, schema: dict[str, Any]) -> Column:
    return v.isNotNull() & (F.size(schema_errors(v, schema)) == 0)


TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def _typed(x: Column, kind: str) -> Column:
    """A value as one of TYPES: text of scalars, whole numbers only for an integer, null for what does not fit."""
    text, shape = F.try_variant_get(x, "$", "string"), F.schema_of_variant(x)
    number = ~shape.isin("STRING", "BOOLEAN", "VOID") & ~F.startswith(shape, F.lit("OBJECT")) & ~F.startswith(shape, F.lit("ARRAY"))
    whole = F.try_variant_get(x, "$", "double")
    if kind == "string":
        return F.when(number, number_text(text)).when(shape.isin("STRING", "BOOLEAN"), text)
    if kind == "integer":
        return F.when(number & (whole == F.floor(whole)), F.try_variant_get(x, "$", "bigint"))
    return F.try_variant_get(x, "$", TYPES.get(kind, "variant"))


def typed_view(items: DataFrame, value: str, schema: dict[str, Any], *keep: str) -> DataFrame:
    """One typed column for each property of the schema; a value of another type is null."""
    cols = []
    for name, sub in schema["properties"].items():
        t = sub.get("type", "string")
        t = next((x for x in ([t] if isinstance(t, str) else t) if x != "null"), "string")
        v = F.element_at("__fields", F.lit(name))
        cols.append(_let(v, lambda x: _typed(x, t)).alias(name))  # noqa: B023
    return items.withColumn("__fields", _fields(F.col(value))).select(*keep, *cols)
