"""What a harvest needs besides frontiers: its configuration, the state of cached responses, pages up to a frontier, windows to
catch up, and which known papers to look at again. Nothing here opens a connection: pages arrive as tables."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.functions.text import HOSTS, ID_BODY
from folioscope.operators import frontier

#: Fixed defaults and bounds of a configuration.
REVIEW_LIMIT, AUTHOR_LIMIT, OVERLAP_DAYS, MAX_PAGES = 500, 8, 2, 4
ARCHIVE = re.compile(r"[a-z]+(?:-[a-z]+)*")


@dataclass
class Config:
    """A harvest's settings. ``errors`` names everything that is wrong; ``checked`` raises if there is anything."""

    listings: list[tuple[str, str]] = field(default_factory=list)
    searches: list[dict] = field(default_factory=list)
    explicit_ids: list[str] = field(default_factory=list)
    known_versions: dict[str, int] = field(default_factory=dict)
    overrides: dict[str, dict] = field(default_factory=dict)
    review_limit: int = REVIEW_LIMIT
    author_limit: int = AUTHOR_LIMIT
    overlap_days: int = OVERLAP_DAYS
    include_due_authors: bool = False
    coverage_through: date | None = None
    expected_latest: date | None = None
    errors: list[str] = field(default_factory=list)

    def checked(self) -> Config:
        if self.errors:
            raise ValueError("; ".join(self.errors))
        return self


def config(value: dict, hosts: Iterable[str] = HOSTS) -> Config:
    """Reads a configuration document; sources and overrides come out in name order, ids without versions."""
    out = Config()
    allowed = {*hosts}

    def need(ok: bool, what: str) -> bool:
        if not ok:
            out.errors.append(what)
        return bool(ok)

    def number(name: str, default: int, least: int) -> int:
        got = value.get(name, default)
        fine = isinstance(got, int) and not isinstance(got, bool) and got >= least
        return got if need(fine, f"{name} must be a whole number of at least {least}") else default

    def day(name: str) -> date | None:
        try:
            return date.fromisoformat(value[name]) if value.get(name) is not None else None
        except (TypeError, ValueError):
            need(False, f"{name} must be a date")
            return None

    def paper(raw: object) -> str | None:
        m = re.fullmatch(rf"(?i)(?:arxiv:)?({ID_BODY})(?:v\d+)?", str(raw).strip())
        return m[1].lower() if need(m is not None, f"{raw!r} is no identifier") else None

    def address(raw: object) -> str:
        link = urlsplit(str(raw))
        plain = link.scheme == "https" and link.hostname in allowed and not link.username and link.port in (None, 443)
        need(plain, f"{raw!r} is no https address of a known host")
        return str(raw)

    need(value.get("schemaVersion", 1) == 1, "schemaVersion has to be 1")
    out.listings = sorted((str(x.get("name", "")), address(x.get("url"))) for x in value.get("listings", []))
    for x in value.get("searches", []):
        pages = x.get("maxPages", MAX_PAGES)
        need(isinstance(pages, int) and pages > 0, "maxPages is below 1")
        marks = [p for raw in x.get("frontier", []) if (p := paper(raw))]
        out.searches.append({"name": str(x.get("name", "")), "url": address(x.get("url")), "frontier": marks, "max_pages": pages, "exhaustive": bool(x.get("exhaustive", False))})
    out.searches.sort(key=lambda s: s["name"])
    out.explicit_ids = sorted({p for raw in value.get("explicitIds", []) if (p := paper(raw))})
    for raw, version in value.get("knownVersions", {}).items():
        if need(isinstance(version, int) and version > 0, "known versions must be positive") and (p := paper(raw)):
            out.known_versions[p] = version
    for x in value.get("authorSearchOverrides", []):
        key = " ".join(str(x.get("author", "")).casefold().split())
        evidence = x.get("identityEvidence")
        need(bool(key) and bool(str(x.get("query", "")).strip()), "an override needs an author and a query")
        need(ARCHIVE.fullmatch(str(x.get("physicsArchive", ""))) is not None, "an override needs the name of an archive")
        told = isinstance(evidence, dict) and evidence and all(str(k).strip() and str(v).strip() for k, v in evidence.items())
        need(told, "an override needs evidence of identity")
        need(key not in out.overrides, f"two overrides for {key!r}")
        out.overrides[key] = {"query": str(x.get("query", "")).strip(), "archive": x.get("physicsArchive"), "evidence": dict(sorted(evidence.items())) if told else {}}
    out.overrides = dict(sorted(out.overrides.items()))
    out.review_limit, out.author_limit = number("reviewLimit", REVIEW_LIMIT, 1), number("authorLimit", AUTHOR_LIMIT, 0)
    out.overlap_days = number("overlapDays", OVERLAP_DAYS, 0)
    out.include_due_authors = bool(value.get("includeDueAuthors", False))
    out.coverage_through, out.expected_latest = day("coverageThrough"), day("expectedLatestDate")
    return out


def cache_action(responses: DataFrame, now: Column, fresh_seconds: int = 900, most_bytes: int = 8_000_000, hosts: Iterable[str] = HOSTS) -> DataFrame:
    """``responses(url, fetched_at, etag, last_modified, mime, body, sha)`` with what to do about each: reject (host or type not
    allowed, or too large), use (fresh and whole), revalidate (whole, old, with a validator), fetch."""
    host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
    known = host.isin(*hosts) & F.startswith("url", F.lit("https://"))
    page = F.coalesce(F.col("mime"), F.lit("text/html")).rlike(r"(?i)^(?:text/html|application/xhtml\+xml)\s*(?:;|$)")
    whole = F.coalesce(F.sha2(F.col("body").cast("binary"), 256) == F.col("sha"), F.lit(False))
    age = F.unix_timestamp(now) - F.unix_timestamp("fetched_at")
    action = (
        F.when(~known | ~page | (F.coalesce(F.octet_length("body"), F.lit(0)) > most_bytes), "reject")
        .when(whole & age.between(0, fresh_seconds), "use")
        .when(whole & F.coalesce("etag", "last_modified").isNotNull(), "revalidate")
        .otherwise("fetch")
    )
    return responses.withColumn("action", action)


def retry_delay(attempt: Column, status: Column, retry_after: Column, first: float = 1.0, most: float = 60.0) -> Column:
    """Seconds until the next try, or null for a status that no try mends: what the answer asks for, else doubled each time."""
    mends = status.isNull() | status.isin(408, 425, 429) | (status >= 500)
    return F.when(mends, F.least(F.lit(most), F.coalesce(retry_after.cast("double"), F.lit(first) * F.pow(F.lit(2.0), attempt))))


def pages_to_frontier(pages: DataFrame, marks: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Per source of ``pages(source, page, pos, id)``: which pages had to be read (up to the one with the first id of
    ``marks(source, id)``), whether it was met, and an error where ``max_pages`` didn't reach it."""
    at = F.struct("page", "pos").alias("at")
    rows = pages.select("source", "page", at, "id")
    hits = rows.join(marks.select("source", "id").distinct(), ["source", "id"], "left_semi").groupBy("source").agg(F.min("at").alias("stop"))
    per = rows.groupBy("source").agg(F.max("page").alias("last"), F.min("page").alias("first")).join(hits, "source", "left")
    need = F.coalesce(F.col("stop.page"), F.col("last")) - F.col("first") + 1
    error = F.when(F.col("stop").isNull() & (need >= max_pages), "no frontier id").when(need > max_pages, "too many pages")
    return per.select("source", need.cast("long").alias("n_pages"), F.col("stop").isNotNull().alias("met"), error.alias("error"))


def new_on_pages(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(source, page, pos, id): distinct ids before the source's frontier, across pages."""
    ranked = pages.select("source", F.struct("page", "pos").alias("pos"), "id")
    return frontier.delta(ranked, marks).select("source", "pos.page", "pos.pos", "id")


def catch_up_windows(authors: DataFrame, plan_start: Column, plan_end: Column, overlap_days: int = OVERLAP_DAYS) -> DataFrame:
    """(author, low, high, cursor, error) for ``authors(author, has_frontier, first_seen, covered_through, catalogue_scan)`` without
    a frontier: from the earliest of the planned start and what is covered less the overlap (or, never covered, the
    first sighting and the catalogue's last scan) to the planned end. The cursor never goes back."""
    due = authors.where(~F.coalesce("has_frontier", F.lit(False)))
    never = F.col("covered_through").isNull()
    anchor = F.when(never, F.to_date("first_seen")).otherwise(F.date_sub("covered_through", overlap_days))
    low = F.least(anchor, plan_start, F.when(never, F.to_date("catalogue_scan")))
    return due.select(
        "author", low.alias("low"), plan_end.alias("high"), F.greatest("covered_through", plan_end).alias("cursor"),
        F.when(F.col("first_seen").isNull(), "no committed frontier or first sighting").alias("error"),
    )


def to_hydrate(seen: DataFrame, known: DataFrame, explicit: DataFrame) -> DataFrame:
    """(id, why): ids to look up: explicit ones, new ones, and known ones that an announcement brought up again (their
    version may have moved)."""
    ids = seen.select("id").distinct()
    again = ids.join(known.select("id").distinct(), "id", "left_semi").withColumn("why", F.lit("resurfaced"))
    fresh = ids.join(known.select("id").distinct(), "id", "left_anti").withColumn("why", F.lit("new"))
    asked = explicit.select("id").distinct().withColumn("why", F.lit("explicit"))
    return again.union(fresh).union(asked).groupBy("id").agg(F.min("why").alias("why"))


def listing_problems(pages: DataFrame, claims: DataFrame, entries: DataFrame) -> DataFrame:
    """(page, error) of listings that aren't whole: ``pages(page, container, total, dated)``, ``claims(page, shown, total)`` of
    their sections, ``entries(page, id)``. A page that states no entries is whole if it names its day."""
    found = entries.groupBy("page").agg(F.countDistinct("id").alias("n"))
    partial = claims.where(F.col("shown") < F.col("total")).select("page").distinct().withColumn("partial", F.lit(True))
    rows = pages.join(found, "page", "left").join(partial, "page", "left")
    n = F.coalesce("n", F.lit(0))
    error = (
        F.when((n == 0) & (F.col("total") == 0), F.when(~F.col("dated"), "no day"))
        .when(~F.col("container"), "no container")
        .when(F.col("partial"), "partial")
        .when(n == 0, "no entries")
        .when(F.col("total") != n, "count mismatch")
    )
    return rows.select("page", error.alias("error")).where("error is not null")


def search_problems(pages: DataFrame, marks: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(source, n_pages, met, error) of searches read newest first: ``pages(source, page, total, ids)`` numbered from 1 without
    gaps, the last one of a source being its results' end. Pages are read up to the first with an id of ``marks(source, id)``."""
    rows = pages.select("source", "page", "total", F.explode_outer("ids").alias("id"))
    known = marks.select("source", "id").distinct()
    stops = rows.join(known, ["source", "id"], "left_semi").groupBy("source").agg(F.min("page").alias("stop"))
    ends = pages.groupBy("source").agg(F.max("page").alias("last"))
    bound = ends.join(stops, "source", "left").join(known.select("source").distinct().withColumn("has", F.lit(True)), "source", "left")
    bound = bound.withColumn("upto", F.least("last", F.coalesce("stop", F.col("last")), F.lit(max_pages)))
    read = rows.join(bound.select("source", "upto"), "source").where("page <= upto")
    # a page may repeat an id, two pages may not
    per_id = read.groupBy("source", "id").agg(
        F.countDistinct("page").alias("on"), F.min("total").alias("least"), F.max("total").alias("most"), F.bool_or(F.col("total").isNull()).alias("unsaid")
    )
    per = per_id.groupBy("source").agg(
        F.count("id").alias("n"), (F.max(F.when(F.col("id").isNotNull(), F.col("on"))) > 1).alias("again"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.bool_or("unsaid").alias("unsaid"),
    )
    met = F.col("stop").isNotNull() & (F.col("stop") <= F.col("upto"))
    ended = ~met & (F.col("upto") == F.col("last"))
    error = (
        F.when(F.col("unsaid"), "no total")
        .when(F.col("least") != F.col("most"), "total changed")
        .when(F.col("again"), "repeated ids")
        .when(ended & (F.col("n") != F.col("most")), "total not reached")
        .when(~met & ~ended, "too many pages")
        .when(ended & F.col("has"), "frontier not met")
    )
    return bound.join(per, "source").select("source", F.col("upto").cast("long").alias("n_pages"), met.alias("met"), error.alias("error"))


def coverage_problems(evidence: DataFrame, plan: tuple[str, str], bound: tuple[str, str] | None = None, newest: str | None = None) -> DataFrame:
    """(source, error) where ``evidence(source, earliest, latest)`` doesn't cover the planned days up to ``newest`` (their end
    where none is given); a plan other than the one bound to the run is an error of its own."""
    if bound and bound != plan:
        raise ValueError(f"the run is bound to {bound[0]} to {bound[1]}, the plan is {plan[0]} to {plan[1]}")
    late = F.coalesce(F.col("earliest") > plan[0], F.lit(True))
    early = F.coalesce(F.col("latest") < (newest or plan[1]), F.lit(True))
    error = F.when(late, "starts late").when(early, "ends early")
    return evidence.select("source", error.alias("error")).where("error is not null")


def delta_batches(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(source, batch_key, payload_sha, n): the discoveries of each page of ``pages(source, page, pos, id, page_sha)``. A batch is
    known by its frontier and page, its payload by the page's content, the frontier and the new ids, so an equal one replays."""
    fronts = marks.select("source", "id").distinct().groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), ",").alias("front"))
    ids = F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("string").alias("id"))))
    new = new_on_pages(pages, marks).groupBy("source", "page").agg(F.array_join(F.transform(ids, lambda x: x["id"]), ",").alias("ids"), F.count("*").alias("n"))
    shas = pages.select("source", "page", "page_sha").distinct()
    rows = new.join(shas, ["source", "page"]).join(fronts, "source", "left").withColumn("front", F.coalesce("front", F.lit("")))
    key = F.concat(F.lit("frontier:"), F.substring(F.sha2("front", 256), 1, 16), F.lit(":page:"), F.col("page").cast("string"))
    return rows.select("source", key.alias("batch_key"), F.sha2(F.concat_ws("|", "page_sha", "front", "ids"), 256).alias("payload_sha"), "n")


def author_queries(authors: DataFrame, overrides: DataFrame) -> DataFrame:
    """``authors(id, name)`` with the search to run: that of ``overrides(name, query, archive)`` whose normalised name is the
    same, else the name; collaborations are skipped. Overrides are a configuration's, one a name (the first by query where
    several fold to one)."""
    of = overrides.groupBy(text.author_key("name").alias("key")).agg(F.min(F.struct("query", "archive")).alias("o"))
    rows = authors.withColumn("key", text.author_key("name")).join(of, "key", "left")
    skipped = F.col("name").rlike(r"(?i)\bcollaboration\b")
    return rows.select(
        "id", skipped.alias("skipped"), F.when(~skipped, F.coalesce("o.query", "name")).alias("query"), F.when(~skipped, F.col("o.archive")).alias("archive")
    )
