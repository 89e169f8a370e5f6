"""Every query with SQL against DuckDB, every other one for rows; the schema names must agree."""

import pytest

from folioscope import registry

from .conftest import SF

NAMES = sorted(registry.queries())


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols, rows = sorted(df.columns), df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    theirs = [c[0] for c in got.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    want = sorted(tuple(shown(r[i]) for i in at) for r in got.fetchall())
    assert sorted(tuple(shown(r[c]) for c in cols) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}


def test_whole_tables(spark):
    """No row of a table is left out."""
    q = registry.queries()
    n = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").count()
    assert sum(len(r["versions"].split(",")) for r in q["heads_map"](spark, SF).collect()) == n("events")
    assert q["change_detection"](spark, SF).count() == n("events")
    assert q["upsert_merge"](spark, SF).count() == n("orders") and q["insert_ignore"](spark, SF).count() == n("customer")
    lines, parts = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "part"))
    orphans = lines.join(parts, lines["l_orderkey"] == parts["p_partkey"], "left_anti").count()
    assert q["violations"](spark, SF).where("rule = 'foreign'").count() == orphans > 0
