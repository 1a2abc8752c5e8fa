"""Classification, JSON, HTML and gate cases."""

import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from harrow.functions import jsonx as J
from harrow.functions import text as X
from harrow.operators import gate as G
from harrow.operators import schema as S2
from harrow.sources import fixtures as S
from harrow.sources import html as D
from harrow.sources import json_outline as O

PAGE = "<html><article>" + "word " * 500 + "</article></html>"


@pytest.mark.parametrize(
    ("status", "kind", "body", "outcome"),
    [(s, "", PAGE, "blocked") for s in (401, 403, 407, 429, 451)]
    + [
        (200, "", PAGE, "ok"),
        (404, "", PAGE, "fetch_error"),
        (404, "", "not here", "blocked"),
        (503, "", PAGE, "fetch_error"),
        (None, None, None, "fetch_error"),
        (200, "application/json", "{", "ok"),
        (200, "", ' {"a": 1} ', "ok"),
        (200, "", '{"a": 1} x', "blocked"),
        (200, "text/html", "x" * 20000, "ok"),
        (200, "text/html", "x" * 2000, "blocked"),
        (200, "", "<title>Just a moment</title>" + PAGE, "blocked"),
        (200, "", "Checking your browser " + PAGE, "blocked"),
        (200, "", "PerimeterX" + PAGE, "blocked"),
    ],
)
def test_outcome(spark, status, kind, body, outcome):
    d = spark.createDataFrame([(status, kind, body)], "s int, k string, b string")
    assert d.select(X.fetch_outcome(F.col("s"), F.col("k"), F.col("b"))).first()[0] == outcome


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_scalars(spark):
    assert one(spark, X.parse_price_de, "€ 1.450,00", "€ 2.100,50", "Preis auf Anfrage", "0", None, "1,2,3") == [1450.0, 2100.5, None, None, None, None]
    assert one(spark, X.size_m2, "78,5 m²", "3 Zimmer") == [78.5, None]
    assert one(spark, X.rooms, "4,5 Zimmer", "Balkon") == [4.5, None]
    assert one(spark, X.anchor_stem, "card-1000", "card_12", "12345") == ["card", "card_12", "12345"]
    assert one(spark, X.host_of, "http://u:p@H.de:80/x", "nope", None) == ["h.de:80", None, None]
    assert one(spark, X.district, "1010 Wien, 1. Bezirk, A", "1010 Wien") == ["1. Bezirk, A", None]
    assert one(spark, X.is_positional, "a:nth-child(2)", "x > b > i", "x > b", "x > .a > b", "q, a > * > b") == [True, True, False, False, True]
    assert one(spark, lambda c: X.truncate_ws(c, 5), " a  b\n", "abcdef") == ["a b", "abcde…"]


SCHEMA = {"type": "object", "additionalProperties": False, "required": ["id", "title"], "properties": {"id": {"type": "string"}, "title": {"type": "string", "minLength": 1}, "points": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}


def test_schema(spark):
    texts = ['{"id":"1","title":"a"}', '{"id":"1"}', '{"id":1,"title":"a"}', '{"id":"1","title":"a","x":1}', '{"id":"1","title":"a","points":1.0}', '{"id":"1","title":"a","points":1.5}', '{"id":"1","title":"a","tags":["x",1]}', "[]", "nope", None]
    assert one(spark, lambda c: J.is_valid(J.variant(c), SCHEMA), *texts) == [True, False, False, False, True, False, False, False, False, False]
    with pytest.raises(J.RecursiveSchema):
        J.schema_errors(F.col("x"), {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"})
    with pytest.raises(ValueError):
        J.schema_errors(F.col("x"), {"$dynamicRef": "#node"})


KEYWORDS = [
    ({"enum": [1, "a", {"k": [1.0]}]}, ["1", "1.0", '"a"', '{"k":[1]}', "2", '"b"'], [True, True, True, True, False, False]),
    ({"const": 100}, ["1e2", "100.0", "101", '"100"'], [True, True, False, False]),
    ({"maxLength": 2, "minLength": 1}, ['"ab"', '"abc"', '""', "123"], [True, False, False, True]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, ["[1]", "[1,2]", "[1,1.0]", "[]", "[1,2,3]", "{}"], [True, True, False, False, False, True]),
    ({"minimum": 1, "exclusiveMaximum": 3, "multipleOf": 0.5}, ["1", "2.5", "3", "0.5", "1.2", '"x"'], [True, True, False, False, False, True]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5, "type": "number"}]}, ['"x"', "7", "3", "null"], [True, True, False, False]),
    ({"oneOf": [{"minimum": 2}, {"maximum": 4}]}, ["1", "3", "5"], [True, False, True]),
    ({"allOf": [{"minimum": 2}, {"maximum": 4}], "not": {"const": 3}}, ["2", "3", "5"], [True, False, False]),
    ({"additionalProperties": {"type": "string"}, "properties": {"n": {"type": "integer"}}}, ['{"n":1,"x":"a"}', '{"n":1,"x":2}', '{"n":1.5}'], [True, False, False]),
    ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": False}, ['{"n_a":1}', '{"n_a":"1"}', '{"b":1}'], [True, False, False]),
    ({"properties": {"it's a": {"type": "string"}}, "required": ["it's a"]}, ['{"it\'s a":"x"}', '{"it\'s a":1}', "{}"], [True, False, False]),
    ({"$defs": {"p": {"type": "integer"}}, "items": {"$ref": "#/$defs/p"}}, ["[1,2]", "[1,2.5]"], [True, False]),
    ({"contains": {"const": 1}, "minProperties": 1}, ["[2,1]", "[2]", "{}"], [True, False, False]),
    ({"type": "string", "format": "uri", "x-note": 1, "default": "d"}, ['"anything"', "1"], [True, False]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"required": ["a"]}, "else": {"required": ["b"]}}, ['{"k":1,"a":0}', '{"k":1,"b":0}', '{"k":2,"b":0}', "{}", "3"], [True, False, True, False, True]),
    ({"if": {"type": "string"}}, ['"x"', "1"], [True, True]),
    ({"dependentRequired": {"card": ["address", "name"]}}, ['{"card":1,"address":2,"name":3}', '{"card":1,"name":3}', '{"name":1}', "[]"], [True, False, True, True]),
    ({"dependentSchemas": {"a": {"properties": {"b": {"type": "string"}}}}}, ['{"a":1,"b":"x"}', '{"a":1,"b":2}', '{"b":2}'], [True, False, True]),
    ({"dependencies": {"a": ["b"], "c": {"minProperties": 3}}}, ['{"a":1,"b":1}', '{"a":1}', '{"c":1}', '{"c":1,"d":1,"e":1}'], [True, False, False, True]),
    ({"propertyNames": {"pattern": "^[a-z]+$", "maxLength": 3}}, ['{"ab":1}', '{"Ab":1}', '{"abcd":1}', '{"a\\"b":1}', "{}", "[1]"], [True, False, False, False, True, True]),
    ({"prefixItems": [{"type": "string"}, {"minimum": 2}], "items": {"type": "boolean"}}, ['["a",2,true]', '["a",1]', '["a",2,3]', "[1]", "[]", '["a"]'], [True, False, False, False, True, True]),
    ({"items": [{"type": "string"}, {"type": "number"}], "additionalItems": False}, ['["a",1]', '["a","b"]', '["a",1,2]', '["a"]'], [True, False, False, True]),
    ({"contains": {"type": "number"}, "minContains": 2, "maxContains": 3}, ["[1,2]", '[1,"a"]', "[1,2,3,4]", "{}"], [True, False, False, True]),
    ({"contains": {"type": "number"}, "minContains": 0}, ["[]", '["a"]'], [True, True]),
    ({"allOf": [{"properties": {"a": {}}}], "anyOf": [{"properties": {"b": {"const": 1}}, "required": ["b"]}, {}], "unevaluatedProperties": False}, ['{"a":1,"b":1}', '{"a":1,"b":2}', '{"a":1,"c":1}', "3"], [True, False, False, True]),
    ({"$defs": {"x": {"properties": {"a": {}}}}, "$ref": "#/$defs/x", "unevaluatedProperties": {"type": "string"}}, ['{"a":1,"z":"s"}', '{"a":1,"z":1}'], [True, False]),
    (False, ["1"], [False]),
]


@pytest.mark.parametrize(("schema", "texts", "valid"), KEYWORDS)
def test_schema_keywords(spark, schema, texts, valid):
    assert one(spark, lambda c: J.is_valid(J.variant(c), schema), *texts) == valid


NODE = {
    "type": "object",
    "required": ["id"],
    "properties": {"id": {"type": "integer", "minimum": 0}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}, "uniqueItems": True}, "by": {"additionalProperties": {"$ref": "#/$defs/node"}, "propertyNames": {"maxLength": 2}}},
    "if": {"properties": {"id": {"const": 7}}, "required": ["id"]},
    "then": {"required": ["note"]},
}


def test_recursive_schema(spark):
    """Depth is data; the errors are those of the same schema unrolled."""
    deep = '{"id":1,"kids":[' * 9 + '{"id":-1}' + "]}" * 9
    texts = ['{"id":1}', '{"id":1,"kids":[{"id":2,"kids":[{"id":-3},{"x":1},"s"]},{"id":7}]}', '{"id":7,"note":1,"by":{"a":{"id":1.5},"abc":{"id":1}}}', "[]", deep, '{"id":2,"kids":[{"id":3},{"id":3.0}]}', "nope", None]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string").withColumn("v", J.variant(F.col("t"))).withColumn("node", F.lit("clash"))
    schema = {"$defs": {"node": NODE}, "$ref": "#/$defs/node"}
    got = {r.k: None if r.errors is None else sorted(r.errors) for r in S2.with_schema_errors(d, "v", schema).collect()}
    assert got == {
        0: [],
        1: ["/kids/* required note", "/kids/*/kids/* required id", "/kids/*/kids/* type", "/kids/*/kids/*/id minimum"],
        2: ["/by propertyNames abc", "/by/*/id type"],
        3: ["/ type"],
        4: ["/kids/*" * 9 + "/id minimum"],
        5: ["/kids uniqueItems"],
        6: None,
        7: None,
    }
    unrolled = json.loads(json.dumps(NODE).replace('{"$ref": "#/$defs/node"}', json.dumps(NODE).replace('{"$ref": "#/$defs/node"}', json.dumps({k: NODE[k] for k in ("type", "required", "if", "then")} | {"properties": {"id": NODE["properties"]["id"]}}))))
    for r in S2.with_schema_errors(d.where("k in (1, 2, 3, 5)"), "v", unrolled).collect():
        assert sorted(r.errors) == got[r.k]
    assert S2.with_schema_errors(d.where("k < 0"), "v", schema).count() == 0


def test_recursive_schema_within_the_row(spark):
    """No table of nodes is written; wide levels, with and without children in turn, keep each child with its parent."""
    from harrow.store import made

    def check(x, here=""):
        if not isinstance(x, dict):
            return [f"{here or '/'} type"]
        out = [] if "id" in x else [f"{here or '/'} required id"]
        out += [f"{here}/id minimum"] if x.get("id", 0) < 0 else []
        return out + [e for c in x.get("kids", []) for e in check(c, here + "/kids/*")]

    tree = lambda i, n: {"id": i % 5 - 1, "kids": [tree(i * 7 + k, n - 1) if (i + k) % 3 else {"id": -k} if k % 2 else "s" for k in range(i % 4)]} if n else {"x": i}
    values = [{"id": 1, "kids": [tree(i, 4) for i in range(j, j + 30)]} for j in range(4)]
    schema = {"$defs": {"n": {"type": "object", "required": ["id"], "properties": {"id": {"minimum": 0}, "kids": {"items": {"$ref": "#/$defs/n"}}}}}, "$ref": "#/$defs/n"}
    d = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, t string").withColumn("v", J.variant(F.col("t")))
    before = made()
    got = {r.k: sorted(r.errors) for r in S2.with_schema_errors(d, "v", schema).select("k", "errors").collect()}
    assert made() == before
    assert got == {k: sorted(check(v)) for k, v in enumerate(values)}


def test_schema_loop_without_descent(spark):
    d = spark.createDataFrame([("1",)], "t string").withColumn("v", J.variant(F.col("t")))
    with pytest.raises(J.RecursiveSchema):
        S2.with_schema_errors(d, "v", {"$defs": {"a": {"allOf": [{"$ref": "#/$defs/a"}]}}, "$ref": "#/$defs/a"})


JSON_TEXTS = ['{"a":1} {"b":2}', "[1] [2]", '{"a":1} x}', '{"a":1,"a":2}', '{"a":1}]', '{"a":1}} x', "{},{}", '{"a":"b\'c"}', "{'a':1}", '{"a":"x\\"\'y"}', "[1,]", " \n[]", '{"a":"tab\tx"}', '{"a":01}', "x[]", None, "", '{"a":NaN}', '{"a":[{"b":"}]"}]}', '{"a":"\\\\"}', '{"a":"' + '\\"' * 20000 + '"}']


@pytest.mark.parametrize("setting", ["false", "true"])
def test_json_test_is_strict(spark, setting):
    """Python's parser is as strict, but for NaN; the session's settings do not matter."""

    def strict(t):
        try:
            return t is not None and t.lstrip(" \n")[:1] in ("{", "[") and json.loads(t, parse_constant=lambda x: 1 / 0) is not None
        except (ValueError, ZeroDivisionError):
            return False

    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", setting)
    try:
        assert one(spark, X.looks_like_json, *JSON_TEXTS) == [strict(t) for t in JSON_TEXTS]
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)


def test_numbers_in_canonical_form(spark):
    texts = ["1e2", "100", "100.0", "-0", "0.0", "1.50", "1e-7", "0.000001", "1e21", "1e20", "12345678901234567890", "-1.5e300", '"1e2"', '"a\\"1.0"', '{"b":1.0,"a":[1e0]}', '{"a":1,"a":2}']
    assert one(spark, lambda c: J.canonical(J.variant(c)), *texts) == ["100", "100", "100", "0", "0", "1.5", "1e-7", "0.000001", "1e+21", "100000000000000000000", "12345678901234567000", "-1.5e+300", '"1e2"', '"a\\"1.0"', '{"a":[1],"b":1}', '{"a":2}']
    assert one(spark, lambda c: J.external_key(J.variant(c)), '{"id":7.0}', '{"id":1e3}', '{"it\'s":1,"id":"x"}') == ["7", "1000", "x"]


def test_keys_and_hashes(spark):
    assert one(spark, lambda c: J.external_key(J.variant(c)), '{"id":"x"}', '{"id":true,"key":"k"}', '{"id":"","key":5}', '{"externalKey":"e","id":"i"}', "[1]", '{"id":null}') == ["x", "k", "5", "e", None, None]
    a, b, c = one(spark, lambda c: J.content_hash(J.variant(c)), '{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1}', '{"b":[2,1],"a":1}')
    assert a == b != c


def test_null_rates(spark):
    d = spark.createDataFrame([(1, '{"a":1}'), (1, '{"a":null}'), (1, '{"b":2}'), (1, "[1]")], "g int, p string").withColumn("v", J.variant(F.col("p")))
    assert {r.field: r.rate for r in J.null_rates(d, ["g"], "v", ["a", "z"]).collect()} == {"a": 0.75, "b": 0.75, "z": 1.0}


def test_html(spark):
    page = '<div id=x class="a b"><p>one<br>two<p data-k="v1">three</div><ul><li>a</li><li><b>b</b></li></ul><script>"</p>"</script>'
    d = D.with_elements(spark.createDataFrame([(page,), (None,), ("",)], "h string"), "h")
    found = lambda s: d.select(F.transform(D.select(F.col("elements"), s), lambda e: D.text(e))).first()[0]
    assert found("ul > li") == ["a", "b"]
    assert found("li b") == ["b"]
    assert found("#x p[data-k]") == ["three"]
    assert found('.b [data-k^="v"], script') == ["three", '"</p>"']
    assert [r[0] for r in d.select(F.size("elements")).collect()][1:] == [0, 0]
    with pytest.raises(ValueError):
        D.select(F.col("elements"), "a:hover")


def test_gate(spark):
    items = lambda *xs: [json.dumps(x) for x in xs]
    ok = {"id": "1", "title": "a"}
    rows = [(1, f, items(ok), None, None) for f in range(3)] + [(2, 1, items(ok), None, None), (3, 1, items(ok, {"id": "1"}), None, None), (3, 2, [], None, None), (3, 3, items(ok), None, "boom"), (3, 4, items(ok), items({"title": "a", "id": "1"}), None), (3, 5, items(ok), items({"id": "2", "title": "a"}), None)]
    f = spark.createDataFrame(rows, "source_id bigint, fixture int, i array<string>, e array<string>, error string")
    f = f.withColumn("items", F.transform("i", J.variant)).withColumn("expected", F.transform("e", J.variant))
    rep = G.gate_report(f, SCHEMA)
    assert {(r.source_id, r.fixture): r.failure for r in rep.where("source_id = 3").collect()} == {(3, 1): "schema-invalid", (3, 2): "empty", (3, 3): "exec-error", (3, 4): None, (3, 5): "expected-mismatch"}
    assert {r.source_id: (r.passed, r.too_few) for r in G.gate_verdict(rep).collect()} == {1: (True, False), 2: (False, True), 3: (False, False)}


def test_process(spark):
    body = json.dumps({"items": [{"id": "1", "title": "a"}, {"id": "2", "title": ""}]})
    r = spark.createDataFrame([(1, 200, "", body), (2, 200, "application/json", '{"items":"x"}'), (3, 403, "", body)], "id bigint, status int, content_type string, body string")
    runs, items = G.process(r, SCHEMA)
    assert sorted(map(tuple, runs.collect())) == [(1, "schema_invalid", 2, 1, False, "1 of 2 items failed validation"), (2, "empty", 0, 0, False, None), (3, "blocked", 0, 0, False, "HTTP 403")]
    assert [(x.id, x.external_key) for x in items.collect()] == [(1, "1")]


def test_outline():
    o = O.outline('{"a":[{"x":1,"b":[{"y":1},{"y":2}]}],"c":[1,2],"d":[],"e":"' + "z" * 80 + '"}')
    assert [(a["path"], a["length"], a["keys"]) for a in o["arrays"]] == [("$.a[0].b", 2, ["y"]), ("$.a", 1, ["x", "b"])]
    assert json.loads(o["shape"]) == {"a": [{"x": 1, "b": [{"y": 1}, "…2 items"]}, "…1 items"], "c": [1, "…2 items"], "d": [], "e": "z" * 60 + "…"}
    assert O.outline("{x") is None and O.outline(None) is None and O.outline("<a>") is None


def test_headers(spark):
    d = spark.createDataFrame([({"Content-Type": ["a", "b"], "X": []},)], "m map<string,array<string>>")
    assert d.select(S.headers(F.col("m"))).first()[0] == {"content-type": "a, b"}


def test_decode_and_fixtures(spark, tmp_path):
    assert S.decode_bytes(gzip.compress(b"a"), "gzip") == "a"
    assert S.decode_bytes(zlib.compress(b"a"), "Deflate") == "a"
    assert S.decode_bytes(b"a\xff", "br") == "a�"
    import pyarrow as pa

    text = "a longer body " * 200
    assert S.decode_bytes(pa.Codec("brotli").compress(text.encode()).to_pybytes(), "br") == text
    (tmp_path / "manifest.json").write_text(json.dumps([{"url": "u", "file": "1.body.gz", "status": None}, {"url": "v", "file": "2.body.gz", "status": 404}]))
    for n in "12":
        (tmp_path / f"{n}.body.gz").write_bytes(gzip.compress(f"body {n}".encode()))
    assert sorted((r.url, r.status, r.body) for r in S.load(spark, str(tmp_path)).collect()) == [("u", 200, "body 1"), ("v", 404, "body 2")]


def test_capture_round_trip(spark):
    d = spark.createDataFrame([(1, 404, "é" * 3000), (2, None, ""), (3, 200, None)], "id int, status int, body string")
    kept = S.captured(d)
    assert [(r.id, r.status_code, r.body and gzip.decompress(r.body).decode()) for r in kept.orderBy("id").collect()] == [(1, 404, "é" * 3000), (2, 200, ""), (3, 200, None)]
    assert [r.body for r in S.opened(kept).orderBy("id").collect()] == ["é" * 3000, "", None]


def test_references_without_semicolon():
    page = '<title>a &amp; b&amp</title><p title="x&lt y&gt;">&copy;&amp;amp; &#65; &#65 &nosuch; &</p><script>a&amp&&b</script>'
    text, e = D.parse(page, whole_refs=True)
    assert text == "a & b&amp©&amp; A &#65 &nosuch; &a&amp&&b"
    assert [x["attrs"] for x in e] == [{}, {"title": "x&lt y>"}, {}]
    assert page[e[1]["from"] : e[1]["to"]].startswith("<p title") and page[e[1]["from"] : e[1]["to"]].endswith("&</p>")
    assert D.parse(page)[0].startswith("a & b&©")  # as browsers do


def test_pages_cut_in_a_reference(spark, tmp_path):
    from harrow.plans import catalog

    html = '<!DOCTYPE html><html lang="en"><head><title>T &amp;&amp</title></head><body><nav><ul><li><a href="/">H</a></li></ul></nav><div class="ad">x</div><article><h1>T &amp;&amp</h1></article></body></html>'
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r["title"] for r in catalog.QUERIES["page_outline"](spark, str(tmp_path)).collect()] == ["T &&amp"]
    found = catalog.QUERIES["query_dom_samples"](spark, str(tmp_path)).where("selector like '%article > h1'").collect()
    assert [(r["texts"], r["sources"]) for r in found] == [("T &&amp", "<h1>T &amp;&amp</h1>")]


def test_pages_are_parsed_in_bounded_parts(spark):
    """Neither many pages nor long ones are held together, whatever the batch; no page is lost or moved."""
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(64 << 20))
    rows = [(i, f"<p>{i}</p>" * (30_000 if i % 50 == 0 else 1) if i % 7 else None) for i in range(300)]
    try:
        e = D.with_elements(spark.createDataFrame(rows, "i long, html string").coalesce(1), "html")
        assert {r["i"]: (r["n"], r["t"]) for r in e.select("i", F.size("elements").alias("n"), F.substr("elements_text", F.lit(1), F.lit(3)).alias("t")).collect()} == {i: (h.count("<p>"), (str(i) * 3 if h.count("<p>") > 1 else str(i))[:3]) if h else (0, "") for i, h in rows}
        assert int(spark.conf.get(key)) <= 8 << 20
    finally:
        spark.conf.set(key, old)
    parts = list(D._parts(pa.array([h for _, h in rows])))
    assert [p for part in parts for p in part] == [h for _, h in rows]
    assert max(map(len, parts)) <= 64 and max(sum(len(p or "") for p in part[:-1]) for part in parts) < 1 << 18
