import json

import pytest

from folioscope import cli
from folioscope.operators.runs import Ledger, LedgerError


def test_a_run(spark, tmp_path, capsys):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(LedgerError):
        ledger.status()
    ledger.initialize(spark.createDataFrame([("a", 1), ("b", 1)], "id string, version int"), scan_date="2024-01-03")
    assert ledger.plan("2024-01-07") == {"start": "2024-01-01", "end": "2024-01-05", "authors": [], "cursors": {}}
    ledger.start_run("r1", "2024-01-01", "2024-01-05", ("listings", "references"))
    with pytest.raises(LedgerError, match="another run"):
        ledger.start_run("r2", "2024-01-01", "2024-01-05")

    assert ledger.record_listing("r1", "s", "k", ["c", "a"], "page", "2024-01-05") == "new"
    assert ledger.record_listing("r1", "s", "k", ["a", "c"], "page", "2024-01-05") == "replayed"
    with pytest.raises(LedgerError, match="other ids"):
        ledger.record_listing("r1", "s", "k", ["d"], "page", "2024-01-05")
    assert ledger.record_listing("r1", "s", "k", ["a", "c"], "new page", "2024-01-05") == "new"
    assert [c["reason"] for c in ledger.review_bundle()["candidates"]] == ["metadata_required"]

    seen = spark.createDataFrame([("a", 1, "d1", "2024-01-01"), ("b", 2, "d2", "2024-01-02"), ("c", 1, "d3", "2024-01-03")], cli.SEEN)
    ledger.observe("r1", seen)
    assert [(c["id"], c["reason"]) for c in ledger.review_bundle()["candidates"]] == [("b", "new_version"), ("c", "new_paper")]
    with pytest.raises(LedgerError, match="never observed"):
        ledger.screen("r1", "zz", 1, "relevant")
    ledger.screen("r1", "b", 2, "excluded")
    ledger.screen("r1", "c", 1, "relevant", ["X, Y"])
    assert [(c["id"], c["reason"]) for c in ledger.review_bundle()["candidates"]] == [("c", "accepted_unpublished")]

    ledger.record_references("r1", [("a", 1, ["b", "a", "zz"]), ("b", 1, ["a"])])
    with pytest.raises(LedgerError, match="other references"):
        ledger.record_references("r1", [("a", 1, ["b"])])
    assert sorted(map(tuple, ledger.citations()["edges"].collect())) == [("a", "b")]  # b's head is stale
    ledger.set_cursor("r1", "searches", "q", {"frontier": ["c"]})
    assert ledger.get_cursor("searches", "q") is None
    ledger.set_lane("r1", "listings", "completed")
    with pytest.raises(LedgerError, match="lane"):
        ledger.complete_run("r1", "2024-01-01", "2024-01-05", 1)
    ledger.set_lane("r1", "references", "no_change")
    with pytest.raises(LedgerError, match="accepted papers"):
        ledger.complete_run("r1", "2024-01-01", "2024-01-05", 1)
    ledger.record_references("r1", [("c", 1, [])])
    with pytest.raises(LedgerError, match="catalogue papers"):
        ledger.complete_run("r1", "2024-01-01", "2024-01-05", 1)
    ledger.record_references("r1", [("b", 2, ["a"])])
    with pytest.raises(LedgerError, match="aren't published"):
        ledger.complete_run("r1", "2024-01-01", "2024-01-05", 0)
    ledger.complete_run("r1", "2024-01-01", "2024-01-05", 1)
    assert ledger.get_cursor("searches", "q") == {"frontier": ["c"]}
    assert ledger.plan("2024-01-09")["authors"] == ["X, Y"]

    assert cli.main([str(tmp_path / "ledger"), "status"], spark) == 0
    assert json.loads(capsys.readouterr().out)["runs"] == {"r1": "completed"}
    assert cli.main([str(tmp_path / "ledger"), "abort-run", "r1"], spark) == 2
    assert "isn't running" in json.loads(capsys.readouterr().err)["error"]
    archive = ledger.rebuild(ledger.table("catalogue"))
    assert Ledger(spark, archive).status()["newestRun"] == "r1" and ledger.status()["counts"]["catalogue"] == 2


def test_commands_over_tables(spark, tmp_path, capsys):
    root = str(tmp_path / "ledger")
    ledger = Ledger(spark, root)
    ledger.initialize(spark.createDataFrame([("2401.00001", 1), ("2401.00002", 1)], "id string, version int"), scan_date="2024-01-03")
    ledger.start_run("r", "2024-01-01", "2024-01-05")
    page = '<head><link rel="canonical" href="https://arxiv.org/abs/{0}v1"></head><section id="bib"><h2>References</h2><ul><li>arXiv:{1}</li></ul></section>'
    rows = [("2401.00001", "2401.00002"), ("2401.00002", "2499.00001")]
    (tmp_path / "pages.json").write_text("\n".join(json.dumps({"id": a, "version": 1, "html": page.format(a, b)}) for a, b in rows))
    assert cli.main([root, "references", "r", str(tmp_path / "pages.json")], spark) == 0
    assert cli.main([root, "mapped-citations", str(tmp_path / "edges")], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["edges"] == 1
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "edges")).collect()] == [("2401.00001", "2401.00002")]
    (tmp_path / "bad.json").write_text(json.dumps({"id": "2401.00001", "version": 2, "html": page.format("2401.00001", "2401.00002")}))
    assert cli.main([root, "references", "r", str(tmp_path / "bad.json")], spark) == 2
    (tmp_path / "config.json").write_text(json.dumps({"coverageThrough": "2024-01-07", "authorLimit": 3}))
    assert cli.main([root, "harvest", str(tmp_path / "config.json")], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["plan"]["end"] == "2024-01-05"
    (tmp_path / "config.json").write_text('{"reviewLimit": 0}')
    assert cli.main([root, "harvest", str(tmp_path / "config.json")], spark) == 2
