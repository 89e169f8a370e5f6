"""Segmented scans against loops."""

import random

from pyspark.sql import functions as F

from folioscope.operators.scan import scan


def by_loop(rows, inclusive):
    out, state = {}, {}
    for key, at, x in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or ""), r[1])):
        old = state.get(key, [])
        new = [*old, x]
        seen = [v for v in (new if inclusive else old) if v is not None]
        out[key, at] = (sum(seen) if seen else None, len(seen), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None, seen[0] if seen else None)
        state[key] = new
    return out


def test_scan_equals_a_loop(spark):
    rng = random.Random(5)
    keys = ["hot"] * 400 + [None] * 60 + ["a", "b", "c", "z"] * 10 + [f"k{i}" for i in range(40)]
    rows = [(k, i, None if rng.random() < 0.3 else rng.randint(-50, 50)) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, at long, x long").repartition(5)
    kinds = ["sum", "count", "max", "min", "last", "first"]
    for inclusive in (True, False):
        for how in ({"blocks": 1}, {"blocks": 7}, {"blocks": 40}, {"block": F.floor(F.col("at") / 16)}, {"block": F.lit(0)}):
            got = scan(df, ["key"], ["at"], {k: (k, F.col("x")) for k in kinds}, inclusive, **how).collect()
            assert {(r["key"], r["at"]): tuple(r[k] for k in kinds) for r in got} == by_loop(rows, inclusive)
            assert len(got) == len(rows)


def test_scan_without_keys_or_rows(spark):
    df = spark.range(100).select("id", F.lit(1).alias("n"))
    got = scan(df, [], ["id"], {"n": ("sum", F.col("n")), "before": ("count", F.col("id"))}, inclusive=False, blocks=6).collect()
    assert {r["id"]: (r["n"], r["before"]) for r in got} == {i: (i or None, i) for i in range(100)}
    assert scan(df.where("id < 0"), [], ["id"], {"n": ("sum", F.col("n"))}).count() == 0
