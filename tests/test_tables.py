"""Table upkeep and stored extractors."""

import pytest

from harrow.operators import extractors as E
from harrow.operators import tables as T

GOOD = "def extract(given):\n    return given.json()\n"


@pytest.mark.parametrize(
    ("code", "rule"),
    [
        ("def extract(:", "parse-error"),
        ("def other(x):\n    return []\n", "exports"),
        ("import os\n" + GOOD, "forbidden-import"),
        ("def extract(g):\n    return eval('1')\n", "forbidden-code-generation"),
        ("def extract(g):\n    return open('x')\n", "forbidden-identifier"),
        ("def extract(g):\n    return g.__class__\n", "forbidden-identifier"),
        ("async def _x():\n    pass\n" + GOOD, "forbidden-async"),
        ("def extract(g):\n    sleep(1)\n", "forbidden-timer"),
        ("def extract(g):\n    while True:\n        pass\n", "unbounded-loop"),
        ("def extract(g):\n    return g.select('a:nth-child(2)')\n", "positional-selector"),
        ("def extract(g):\n    return g.select('x > b > i')\n", "positional-selector"),
        ("def extract(g):\n    return output_schema\n", "schema-reference"),
        (GOOD + "# x\n" * 400, "too-long"),
    ],
)
def test_rules(code, rule):
    assert rule in {r for r, _ in E.violations(code)}


def test_allowed():
    assert E.violations(GOOD) == []
    assert E.violations("def extract(g):\n    while True:\n        break\n    return [x for x in g.select('[data-x] > li')]\n") == []


@pytest.mark.parametrize(
    ("body", "bounded"),
    [
        ("while True:\n        for x in [1]:\n            break\n    return []", False),
        ("while True:\n        while False:\n            break\n    return []", False),
        ("while True:\n        for x in [1]:\n            return []", True),
        ("while True:\n        for x in [1]:\n            pass\n        else:\n            break\n    return []", True),
        ("while True:\n        if g:\n            break\n    return []", True),
        ("while True:\n        try:\n            pass\n        except ValueError:\n            break\n    return []", True),
        ("while True:\n        def f():\n            return 1\n    return []", False),
    ],
)
def test_exits_of_loops(body, bounded):
    rules = {r for r, _ in E.violations(f"def extract(g):\n    {body}\n")}
    assert ("unbounded-loop" not in rules) == bounded


@pytest.mark.parametrize("code", ["return [g.source.output_schema]", "return [g.outputSchema]", "return [output_schema]", "return [g.meta['output_schema']]"])
def test_schema_is_out_of_reach(code):
    assert "schema-reference" in {r for r, _ in E.violations(f"def extract(g):\n    {code}\n")}
    assert E.violations("def extract(g):\n    return [{'schema': 'v1'}]\n") == []


def test_runs_start_afresh(spark):
    """A name of the module is as new for every response."""
    code = "seen = []\ndef extract(g):\n    seen.append(g.url)\n    return [len(seen)]\n"
    r = spark.createDataFrame([(i, "u", 200, "") for i in range(5)], "id bigint, url string, status int, body string").coalesce(1)
    assert [x["items"] for x in E.run(r, code).collect()] == [["1"]] * 5


def test_settled_removes_what_it_was_made_of(spark):
    import os

    from harrow.store import made, settled, written

    since = made()
    a = written(spark.range(5), "a")
    b = written(a.where("id > 1"), "b")
    gone = [x.inputFiles()[0].removeprefix("file://") for x in (a, b)]
    out = settled(b.join(a, "id"), "out", since)
    assert made() == since + 1 and out.count() == 3 and not any(map(os.path.exists, gone))


def test_sequence(spark):
    rows = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "k int, v string")
    got = T.sequenced(rows, ["k"], 100).collect()
    assert sorted((r.id, r.k) for r in got) == [(101 + k, k) for k in range(50)]
    assert T.sequenced(rows.where("k < 0"), ["k"]).count() == 0


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from harrow.store import shared_root

    conf = SimpleNamespace(get=lambda *a: None)
    for master, fine in (("yarn", False), ("local-cluster[2,1,512]", False), ("spark://h:7077", False)):
        fake = SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)
        with pytest.raises(ValueError, match="checkpoint"):
            shared_root(fake)


@pytest.mark.parametrize(
    ("code", "outcome"),
    [
        (GOOD, "ok"),
        ("def extract(g):\n    return []\n", "empty"),
        ("def extract(g):\n    return 1 / 0\n", "exec_error"),
        ("def extract(g):\n    return {}\n", "contract_error"),
        ("def extract(g):\n    return [set()]\n", "contract_error"),
        ("def extract(g):\n    n = 0\n    for i in range(10**12):\n        try:\n            n += 1\n        except Exception:\n            pass\n    return [n]\n", "timeout"),
    ],
)
def test_outcomes(code, outcome):
    assert E.run_one(code, {"url": "u", "status": 200, "body": "[1]"}, limit_s=0.3)[1] == outcome


def test_run(spark):
    r = spark.createDataFrame([(1, "u", 200, '[{"a":1}]'), (2, "u", 200, None)], "id bigint, url string, status int, body string")
    assert sorted((x.id, x.outcome, len(x["items"])) for x in E.run(r, GOOD).collect()) == [(1, "ok", 1), (2, "exec_error", 0)]
    with pytest.raises(ValueError):
        E.run(r, "import os")


def test_tables(spark):
    for name in T.SCHEMAS:
        assert T.empty(spark, name).count() == 0
    runs = spark.createDataFrame([(1, "ok", None, "x" * 5000)], "id bigint, outcome string, items int, error string")
    r = T.appended(runs, "run").first()
    assert (r["items"], r.complete, len(r.error)) == (0, True, 4000)
    assert T.unknown_values(runs, "run").count() == 0
    assert T.unknown_values(spark.createDataFrame([("odd",)], "state string"), "job").count() == 1
    rec = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "source_id bigint, external_key string")
    assert [x.external_key for x in T.duplicates(rec, "record").collect()] == ["a"]


def test_scratch(spark):
    import os

    from harrow.store import clean, written

    before = written(spark.range(3), "t")
    path = before.inputFiles()[0].removeprefix("file://")
    assert before.count() == 3 and os.path.exists(path)
    clean(spark)
    assert not os.path.exists(path)


def test_scratch_of_threads_is_apart(spark):
    """What one thread settles or cleans is its own."""
    import threading

    from harrow import store

    kept = store.written(spark.range(3).toDF("n"), "kept")
    seen = {}

    def other() -> None:
        since = store.made()
        first = store.written(spark.range(5).toDF("n"), "first")
        seen["settled"] = store.settled(first.where("n > 1"), "second", since).count()
        store.clean(spark)
        seen["left"] = store.made()

    t = threading.Thread(target=other)
    t.start()
    t.join()
    assert seen == {"settled": 3, "left": 0} and kept.count() == 3
