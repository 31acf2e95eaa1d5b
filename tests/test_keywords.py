import random
import re
import time

from paths import SMALL
from test_alike import rule

from causeway.functions import keywords as K
from causeway.functions import lexicons as L
from causeway.operators import gates as B
from causeway.plans import queries, registry  # noqa: F401  queries fills the registry


def plainly(text, keywords):
    """One predicate a keyword."""
    words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w]
    found = []
    for k in keywords:
        parts = [t for t in re.split("[^a-z0-9]+", k.lower()) if t]
        if parts and (parts[0] in words if len(parts) == 1 else "-".join(parts) in "-".join(words)):
            found.append(k)
    return sorted(set(found))


def test_hits_equal_a_predicate_a_keyword(spark):
    r = random.Random(1)
    lists = {"a": ["gulf council", "gulf-council", "al", "new orleans", "gulf", "--", "of the"], "b": L.GULF, "c": (), "d": L.POLICY}
    pool = ["gulf", "council", "Gulf-Council", "al", "also", "of", "the", "then", "sof", "new", "orleans", "New  Orleans", "fwc", "texas", ".", "é"]
    texts = [" ".join(r.choices(pool, k=r.randint(0, 14))) for _ in range(300)] + [None, "", "- -", "gulf" * 50_000, "sof the", "of then"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    got = {x.i: x.h for x in df.select("i", K.hits("text", lists).alias("h")).collect()}
    assert all(list(got[i][name]) == plainly(t, words) for i, t in enumerate(texts) for name, words in lists.items())
    assert df.limit(0).select(K.hits("text", lists)).count() == 0


def test_cost_does_not_grow_with_the_keywords():
    r = random.Random(2)
    text = "-".join(f"w{r.randrange(5000)}" for _ in range(200_000))

    def seconds(n):
        lists = (("x", tuple(f"k{i} v{i}" for i in range(n))),)
        K.compiled(lists)
        began = time.perf_counter()
        K.matched(text, lists)
        return time.perf_counter() - began

    seconds(10)
    assert min(seconds(4000) for _ in range(3)) < 4 * min(seconds(40) for _ in range(3)) + 0.02


def test_states(spark):
    texts = ["Biloxi then Mobile", "Mobile, Biloxi", "texas florida texas", None, "new-orleans or new orleans", "nothing"]
    rows = B.dominant_state(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")).collect()
    assert [x.state for x in sorted(rows)] == ["Mississippi", "Alabama", "Texas", "Gulf Council", "Louisiana", "Gulf Council"]


def test_similar_names_of_all_parts(spark):
    got = {x["head"]: x.chosen for x in registry.QUERIES["similar_names"](spark, SMALL).collect()}
    assert got == rule(sorted(got), 0.88) and sum(a != b for a, b in got.items()) > 10
