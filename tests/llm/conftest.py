import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Small documents with copies, shared passages and lines, junk, edge cases, ties and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = say(40), "A common line that many DOCUMENTS hold, é."
    out = []
    for i in range(n):
        kind = rng.randrange(8)
        t = ". ".join(say(rng.randint(3, 30)) for _ in range(rng.randint(1, 5)))
        if kind == 0 and out:
            t = rng.choice(out)[1]
        elif kind == 1:
            t = t + " " + passage + "\n" + say(5)
        elif kind == 2:
            t = t + "\n\t" + line + " \n" + say(4) + "\r\n" + line.lower()
        elif kind == 3:
            t = " ".join(x for w in t.split() for x in [w] * 6)
        elif kind == 4:
            t = " ".join(w + "***" for w in t.split())
        out.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1"]), len(t)))
    out += [(n, None, "en", "s0", 0), (n + 1, "", "en", "s0", 0), (n + 2, " \n\t ", None, None, 3), (n + 3, "x", "en", "s1", 1), (n + 4, "ÀÉ ÀÉ" * 3 + " " + line, "fr", "s0", 9)]
    out += [(n + 5, "lang " * 6000 + passage, "en", "s0", 9), (n + 6, line + "\n" + line, "en", "s0", 9)]
    out += [out[1], out[1], (None, out[2][1], "en", "s0", 5), (None, None, None, None, None), (3, "another text under a known id " + passage, "en", "s0", 4)]
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with those the operators use."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, DOC)
    return d.withColumns({c: F.lit("x") for c in ("id", "h", "words", "fp", "kept", "shard", "n", "p", "k1", "first", "__id", "__h", "__n", "__times", "__k", "n_bytes", "row")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
