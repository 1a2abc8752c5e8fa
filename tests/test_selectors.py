"""Selectors on small pages and on random trees, and what outlines make of pages."""

import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import outline as P
from harrow.sources import html as D
from harrow.sources import selectors as S

PAGE = (
    '<html lang="en-GB"><body>\n<div id=x class="a b" lang=en><p>one<br>two<p data-k="v 1">three</div><ul class="A"><li>a</li><li><b>b</b></li>\n'
    '<li class="a">c</li></ul><p>after</p><i></i><em title="x]y,z > q">m</em></body></html>'
)
CASES = [
    ("[class~=a]", ["one...", "c"]), ('p[data-k="v 1"]', ["three"]), ('[lang|="en"] > p', ["one...", "three"][:1]), ('[class="a B" i]', ["one..."]), ('[class="a B"]', []), ('[class="a" i]', ["ab\nc", "c"]),
    ("div + ul", ["ab\nc"]), ("div ~ p", ["after"]), ("ul ~ div", []), ("li:not(:first-child)", ["b", "c"]), ("li:nth-child(2n+1)", ["a", "c"]), ("li:nth-child(-n + 2)", ["a", "b"]), ("li:nth-last-child(1)", ["c"]), ("li:nth-child(even)", ["b"]),
    ("li:is(.a, :first-child)", ["a", "c"]), ("ul:has(b) > li.a", ["c"]), ("li:has(> b)", ["b"]), ("li:not(ul > li:first-child, .a)", ["b"]), ("i:empty", [""]), ("li:only-child", []), ("p:last-of-type + i", [""]),
    ('[title="x]y,z > q"]', ["m"]), ("em[title*='y,z']", ["m"]), ("[title~='q']", ["m"]), ('[class^=""]', []), ("b,  li.a", ["b", "c"]), ("body>ul>li>b", ["b"]), ("#x.b p[data-k]", ["three"]), ("*:root > body > i", [""]),
]


@pytest.fixture(scope="module")
def page(spark):
    return D.with_elements(spark.createDataFrame([(PAGE,), (None,)], "h string"), "h").cache()


@pytest.mark.parametrize(("selector", "texts"), CASES)
def test_selectors(page, selector, texts):
    short = {"onetwothree": "one..."}
    got = page.where("h is not null").select(F.transform(D.select(F.col("elements"), selector), lambda e: D.text(e))).first()[0]
    assert [short.get(x, x) for x in got] == texts


@pytest.mark.parametrize("selector", ["a:hover", "a::before", "[a", "a >", "", " ", "a,,b", "p:nth-child(x)", "a!b", "p[a=b c]", ":not()", "a[b~c]", "> a", "a:not(b", "li:has(> b i)", "a + ", "p:contains(x)", "[a='b]"])
def test_unsupported_raises(selector):
    with pytest.raises(ValueError, match="not supported"):
        D.select(F.col("elements"), selector)


def random_page(rng: random.Random, depth: int = 0) -> str:
    out = ""
    for _ in range(rng.randint(0 if depth else 2, 4)):
        tag = rng.choice(["a", "b", "div"])
        attrs = "".join(f' {k}="{v}"' for k, v in [("class", rng.choice(["x", "x y", "z", ""])), ("id", rng.choice("pq"))] if rng.random() < 0.6)
        out += f"<{tag}{attrs}>" + (random_page(rng, depth + 1) if depth < 4 else "t") + f"</{tag}>"
    return out


def brute(elements, selector):
    """Each complex selector from right to left, by trying all elements."""

    def nth(e, of, last):
        s = [x for x in elements if x["parent"] == e["parent"] and (of == "child" or x["tag"] == e["tag"])]
        return len(s) - s.index(e) if last else s.index(e) + 1

    def test(e, t):
        if t[0] == "tag":
            return e["tag"] == t[1]
        if t[0] == "attr":
            v = e["attrs"].get(t[1])
            return v is not None and {"": lambda: True, "=": lambda: v == t[3], "~=": lambda: t[3] in v.split()}[t[2]]()
        if t[0] == "nth":
            k = nth(e, t[1], t[2]) - t[4]
            return k == 0 if t[3] == 0 else k % abs(t[3]) == 0 and k * t[3] >= 0
        if t[0] == "all":
            return all(test(e, x) for x in t[1])
        if t[0] == "empty":
            return e["last"] == e["pos"] and e["start"] == e["end"]
        if t[0] == "has":
            return any(matches(q, b) and (q["parent"] == e["pos"] if b[0].how == ">" else True) for b in t[1] for q in elements if e["pos"] < q["pos"] <= e["last"])
        return any(matches(e, b) for b in t[1]) == (t[0] == "is")

    def matches(e, steps):
        if not all(test(e, t) for t in steps[-1].tests):
            return False
        if len(steps) == 1:
            return True
        near = {" ": lambda x: x["pos"] < e["pos"] <= x["last"], ">": lambda x: x["pos"] == e["parent"], "+": lambda x: x["parent"] == e["parent"] and nth(x, "child", False) == nth(e, "child", False) - 1, "~": lambda x: x["parent"] == e["parent"] and x["pos"] < e["pos"]}[steps[-1].how]
        return any(near(x) and matches(x, steps[:-1]) for x in elements)

    return [e["pos"] for e in elements if any(matches(e, b) for b in S.parse(selector))]


RANDOM = ["a b", "div > a ~ b", "a + b .x", ".x:not(.y) > *", "div:nth-child(2n) a:last-of-type", ":is(a, b) + :is(.z, #q)", "a:has(b.x)", "div:has(> .z)", "*:not(a > *, :first-child)", "div div ~ a, b:only-child", "[id=p] [class~=y]", ":empty", "a:nth-last-of-type(-n+2)", "div:not(:has(a)) > b"]


def test_random_trees(spark):
    rng = random.Random(4)
    pages = [random_page(rng) for _ in range(25)]
    d = D.with_elements(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string"), "h").cache()
    got = {r.i: r for r in d.select("i", *[S.positions(F.col("elements"), s).alias(f"s{k}") for k, s in enumerate(RANDOM)]).collect()}
    hits = 0
    for i, p in enumerate(pages):
        elements = D.parse(p)[1]
        for k, s in enumerate(RANDOM):
            want = brute(elements, s)
            hits += len(want)
            assert got[i][f"s{k}"] == want, (s, p)
    assert hits > 300


def test_source_spans():
    html = '<div>\n<p class=a>x<b>y</p>\n<br><i/>z</div >tail<p>open'
    spans = {(e["tag"], html[e["from"] : e["to"]]) for e in D.parse(html)[1]}
    assert spans == {("div", '<div>\n<p class=a>x<b>y</p>\n<br><i/>z</div >'), ("p", "<p class=a>x<b>y</p>"), ("b", "<b>y"), ("br", "<br>"), ("i", "<i/>"), ("p", "<p>open")}


def test_outline(spark):
    page = "".join(f'<a role="card" data-testid="result-header-{i}">  row\n {i} {"x" * 90}</a>' for i in range(1000, 1005)) + '<b aria-label="7">s</b><b aria-label="7">t</b><i data-qa="one"></i>'
    d = spark.createDataFrame([(1, page), (2, ""), (3, None)], "p int, h string")
    got = [tuple(r) for r in P.anchors(d, "p", "h").orderBy("p", "rank").collect()]
    sample = "row 1000 " + "x" * 71 + "…"
    assert got == [(1, 1, '[data-testid^="result-header"]', 5, sample), (1, 2, '[role^="card"]', 5, sample), (1, 3, '[aria-label^="7"]', 2, "s")]
    scripts = '<script>var a</script><script type="application/ld+json">{ }</script><script id="__NEXT_DATA__" type="application/ld+json">{}</script><script>window.__S = {short}</script><script> self.__S = ' + "1" * 500 + "</script>"
    got = [(r.rank, r.source, r.chars, len(r.preview)) for r in P.embedded(spark.createDataFrame([(1, scripts)], "p int, h string"), "p", "h").orderBy("rank").collect()]
    assert got == [(1, "application/ld+json", 3, 3), (2, "__NEXT_DATA__", 2, 2), (3, "inline state", 512, 401)]
    (r,) = P.queried(spark.createDataFrame([(1, page)], "p int, h string"), "p", "h", ["[role]"]).collect()
    assert (r.n, len(r.samples), len(r.samples[0].html)) == (5, 5, len(page.split("</a>")[0]) + 4) and r.samples[1].text == "row 1001 " + "x" * 90
