"""Containment by equi-joins against all pairs; queries with their SQL."""

import io
import random
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from oracle import same
from sagelode.functions.text import key_matches
from sagelode.operators import containment
from sagelode.plans import catalogue

SMALL = "/root/testdata/sf0.01"


def test_containing_equals_all_pairs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abü1") for _ in range(rng.randrange(1, 7)))
    texts = [(i, rng.choice([" ", "(", ", "]).join(word() for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(60, None), (None, "a")]
    cut = [t[1][i : i + rng.randrange(1, 12)] for t in texts[:60] if t[1] for i in [rng.randrange(len(t[1]))]]
    needles = cut + [word() for _ in range(40)] + ["(", "", None, "a", "a"]
    got = containment.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "text_id long, text string"))
    want = {(n, i) for n in set(needles) if n and any(c.isalnum() for c in n) for i, t in texts if i is not None and t is not None and n in t}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_keys_above_are_the_prefix_matches(spark):
    keys = ["CGST_SEC_17", "CGST_SEC_17_5", "CGST_SEC_17A", "CGST_SEC_170", "CGST_SCHED_II", "CGST_SCHED_III", "A", ""]
    pairs = spark.createDataFrame([(a, b) for a in keys for b in keys if b], "key string, target string")
    rows = pairs.select("key", "target", key_matches(F.col("key"), F.col("target")).alias("want"), F.array_contains(containment.above(F.col("key")), F.col("target")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


@pytest.mark.parametrize("name", ["citation_verify", "verification_score", "statute_first", "resolved_keys", "citation_overlap", "complexity_bands", "coverage_fill", "source_list"])
def test_query_equals_sql(spark, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    same(df, catalogue.ORACLES[name], SMALL)
    if name in ("citation_verify", "statute_first", "citation_overlap"):
        shown = io.StringIO()
        with redirect_stdout(shown):
            df.explain()
        assert "NestedLoop" not in shown.getvalue() and "Cartesian" not in shown.getvalue()
        assert df.count() > 0
