from datetime import date

import pytest
from pyspark.sql import functions as F

from folioscope.functions import dates, numbers, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [("  Élan – 12 ± 3 mm; Öre\nTOP  ", "elan 12 3 mm ore top"), ("plain_TEXT, 1.5!", "plain text 1 5"), (None, ""), ("ﬁx ²", "fix 2"), ("日本 Ⅷ·x", "日本 viii x")],
)
def test_search_text(spark, raw, want):
    assert one(spark, raw, lambda c: text.search_text(c)) == want


def test_author_key(spark):
    assert one(spark, "  Straße \t A", text.author_key) == "strasse a"
    assert one(spark, None, text.author_key) is None


@pytest.mark.parametrize(
    "raw, want",
    [
        ("https://arxiv.org/abs/2401.01234v3?x=1#y", ("2401.01234", 3)),
        ("arXiv:HEP-ph/9901001", ("hep-ph/9901001", None)),
        ("/2401.1234.pdf", ("2401.1234", None)),
        ("2401.123", (None, None)),
        ("", (None, None)),
    ],
)
def test_normalize_id(spark, raw, want):
    assert tuple(one(spark, raw, text.normalize_id)) == want


def test_bare_ids(spark):
    said = "see astro- ph/0101001v2, arXiv: 2401.00001v1 and x2402.00002, 2403.00003/4"
    assert one(spark, said, text.bare_ids) == ["2401.00001", "astro-ph/0101001"]


def test_id_from_href(spark):
    assert one(spark, "https://arxiv.org/pdf/2401.01234v2.pdf", text.id_from_href) == "2401.01234"
    assert one(spark, "https://doi.org/10.48550/arXiv.2401.01234", text.id_from_href) == "2401.01234"
    assert one(spark, "https://example.org/x", text.id_from_href) is None


@pytest.mark.parametrize(
    "names, want",
    [([], None), (["A"], "A"), (["A", " B "], "A, B"), (["A", "B", "C", "D", "E"], "A et al."), (["A", "The X Collaboration"], "The X Collaboration")],
)
def test_author_label(spark, names, want):
    assert one(spark, names, text.author_label, "array<string>") == want


def test_wrap(spark):
    assert one(spark, " short  label ", text.wrap_label) == ["short label"]
    assert one(spark, "Nuclear responses and effective operators", text.wrap_label) == ["Nuclear responses and", "effective operators"]


def test_truncate(spark):
    assert one(spark, "a" * 158, text.truncate_words) == "a" * 158
    assert one(spark, "ab " * 80, text.truncate_words) == ("ab " * 52).rstrip() + "…"


@pytest.mark.parametrize(
    "raw, want", [("2024-02-29", date(2024, 2, 29)), ("2023-02-29", None), ("2024-2-9", None), ("0099-01-01", None), (None, None), (" 2024-01-01", None)]
)
def test_strict_iso(spark, raw, want):
    assert one(spark, raw, dates.strict_iso) == want


@pytest.mark.parametrize("raw, want", [("3/4/24", date(2024, 4, 3)), ("03/04/2024", date(2024, 4, 3)), ("31/2/24", None), ("1/1/1", None)])
def test_day_month_year(spark, raw, want):
    assert one(spark, raw, dates.day_month_year) == want


def test_announcement_day(spark):
    week = {f"2024-01-0{d}": date(2024, 1, w) for d, w in ((5, 5), (6, 5), (7, 5), (8, 8))}
    assert {k: one(spark, k, lambda c: dates.announcement_day(c.cast("date"))) for k in week} == week
    assert dates.plan_window(date(2024, 1, 7), date(2024, 1, 3)) == (date(2024, 1, 1), date(2024, 1, 5))


def test_long_date(spark):
    assert one(spark, "Monday, 3 November 2025", dates.long_date) == date(2025, 11, 3)
    assert one(spark, "3 Nov 2025", dates.long_date) == date(2025, 11, 3)
    assert one(spark, "soon", dates.long_date) is None


def test_params():
    lo, hi = date(2020, 1, 1), date(2021, 1, 1)
    assert dates.range_to_params(lo, hi, lo, hi, "q=1&from=x") == "q=1"
    said = dates.range_to_params(date(2020, 2, 1), hi, lo, hi, "q=1")
    assert said == "q=1&from=2020-02-01&to=2021-01-01"
    assert dates.range_from_params(said, lo, hi) == (date(2020, 2, 1), hi)
    assert dates.range_from_params("from=2022-01-01&to=2020-06-01", lo, hi) == (date(2020, 6, 1), hi)
    assert dates.range_from_params("from=nonsense", lo, hi) == (lo, hi)
    assert dates.mail_time("Tue, 3 Nov 2025 18:00:00 -0500") == "2025-11-03T23:00:00Z"


def test_diameter(spark):
    d = [one(spark, float(c), numbers.citation_diameter, "double") for c in (-3, 0, 1, 3, 15, 51, 64, 900)]
    assert d[0] == d[1] == 14 and d[-1] == d[-2] == pytest.approx(44)
    assert d[1:-1] == sorted({*d[1:-1]})
    with pytest.raises(ValueError):
        numbers.citation_diameter(F.lit(1), least=9, most=3)


def test_rounding(spark):
    assert [one(spark, x, numbers.round_half_up, "double") for x in (0.0005, -0.0005, 1.2344)] == [0.001, 0.0, 1.234]


def test_fnv(spark):
    h = 2166136261
    for c in b"a:b":
        h = ((h ^ c) * 16777619) % (1 << 32)
    assert one(spark, "a:b", numbers.fnv1a) == h


def test_texts_go_to_python_in_small_batches(spark):
    from folioscope.plans import catalogue

    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in (catalogue.search_text, catalogue.search_text_variant, catalogue.search_contains):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        q(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
