"""Sinks: single small artefacts through the driver, bulk tables through Spark's committer."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import digest_tree
from folioscope.session import materialize


def write_atomic(path: str, body: str) -> None:
    """Temporary file and rename, for a file on the driver's own disk."""
    side = f"{path}.tmp"
    with open(side, "w", encoding="utf-8", newline="\n") as f:
        f.write(body)
    os.replace(side, path)


class Shared:
    """Small files in any store that Spark can reach, the driver's disk among them."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, body: str) -> None:
        """A file beside it and a rename over it: a reader sees the old or the new one, whole."""
        side = f"{path}.tmp"
        out = self.fs.create(self._path(side), True)
        out.write(bytearray(body.encode("utf-8")))
        out.close()
        self._rename(side, path, "OVERWRITE")

    def move(self, old: str, new: str) -> None:
        """A file or folder to a place where nothing is."""
        self._rename(old, new, "NONE")

    def _rename(self, old: str, new: str, how: str) -> None:
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.valueOf(how)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(self._path(old)), self.fs.makeQualified(self._path(new)), options)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def write_json(path: str, value: object) -> None:
    write_atomic(path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def write_or_check(path: str, value: object, check: bool) -> bool:
    """Writes an artefact, or with ``check`` says whether the file holds it already, byte for byte."""
    body = json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    if not check:
        write_atomic(path, body)
        return True
    with open(path, encoding="utf-8") as f:
        return f.read() == body


def sitemap_rows(pages: DataFrame, url: str, modified: Column) -> DataFrame:
    """(url, entry): one <url> element a row; a null date has no <lastmod>."""
    stamp = F.coalesce(F.concat(F.lit("\n    <lastmod>"), text.escape_xml(modified.cast("string")), F.lit("</lastmod>")), F.lit(""))
    entry = F.concat(F.lit("  <url>\n    <loc>"), text.escape_xml(F.col(url)), F.lit("</loc>"), stamp, F.lit("\n  </url>"))
    return pages.select(F.col(url).alias("url"), entry.alias("entry"))


def sitemap(entries: list[str]) -> str:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return head + "\n".join(entries) + "\n</urlset>\n"


def json_ld(kind: str, **fields: Column | str) -> Column:
    """A JSON-LD object that is safe inside a script element."""
    parts = [F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type")]
    parts += [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]
    return text.escape_json_ld(F.to_json(F.struct(*parts)))


def bibtex(key: str, **fields: Column) -> Column:
    """A @misc entry; null fields are left out."""
    lines = [F.concat(F.lit(f"  {n} = {{"), c, F.lit("},")) for n, c in fields.items()]
    return F.concat_ws("\n", F.lit(f"@misc{{{key},"), *lines, F.lit("}"))


def collection_page(name: Column, description: Column, url: Column, count: Column) -> Column:
    items = F.struct(F.lit("ItemList").alias("@type"), count.alias("numberOfItems"))
    return json_ld("CollectionPage", name=name, description=description, url=url, mainEntity=items)


def scholarly_article(title: Column, authors: Column, published: Column, modified: Column, url: Column, same_as: Column, summary: Column) -> Column:
    people = F.transform(authors, lambda a: F.struct(F.lit("Person").alias("@type"), a.alias("name")))
    return json_ld(
        "ScholarlyArticle", headline=title, author=people, datePublished=published.cast("string"), dateModified=modified.cast("string"),
        url=url, sameAs=same_as, abstract=summary,
    )


def breadcrumbs(*steps: tuple[Column, Column]) -> Column:
    """A BreadcrumbList of (name, address) steps, places from 1."""
    items = [
        F.struct(F.lit("ListItem").alias("@type"), F.lit(k).alias("position"), name.alias("name"), url.alias("item"))
        for k, (name, url) in enumerate(steps, 1)
    ]
    return json_ld("BreadcrumbList", itemListElement=F.array(*items))


def append_summary(path: str, lines: list[str]) -> None:
    """Adds a run's lines to a step summary on the driver's disk."""
    with open(path, "a", encoding="utf-8", newline="\n") as f:
        f.write("\n".join(lines) + "\n")


INDEX = "id string, citedBy array<string>, incomingCitationCount long, searchText string"


def index_rows(papers: DataFrame, edges: DataFrame, text_of: Column) -> DataFrame:
    """The search index of ``papers(id, pos, ...)``: who cites each in catalogue order, how many, and its search text."""
    order = papers.select(F.col("id").alias("src"), "pos")
    met = edges.join(order, "src").join(papers.select(F.col("id").alias("dst")), "dst", "left_semi")
    lists = met.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set(F.struct("pos", "src"))).alias("xs"))
    by = F.coalesce(F.transform("xs", lambda x: x["src"]), F.array().cast("array<string>"))
    rows = papers.select("id", text_of.alias("searchText")).join(lists, "id", "left")
    return rows.select("id", by.alias("citedBy"), F.size(by).cast("long").alias("incomingCitationCount"), "searchText")


def index_problems(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(rule, key, detail) where a stored index differs from one built afresh: ids missing or unknown or repeated, citing
    papers in other order, counts that don't fit, other text. Both sides are hashed by id, none is collected."""
    one, two = stored.alias("one"), rebuilt.alias("two")
    both = one.join(two, F.col("one.id") == F.col("two.id"), "full_outer")
    differs = lambda c: ~F.col(f"one.{c}").eqNullSafe(F.col(f"two.{c}"))
    why = (
        F.when(F.col("one.id").isNull(), "missing")
        .when(F.col("two.id").isNull(), "unknown")
        .when(differs("citedBy"), "citedBy")
        .when(differs("incomingCitationCount"), "count")
        .when(differs("searchText"), "text")
    )
    bad = both.select(why.alias("rule"), F.coalesce("one.id", "two.id").alias("key"), F.lit("").alias("detail")).where("rule is not null")
    again = stored.groupBy(F.col("id").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return bad.unionByName(again.select(F.lit("repeated").alias("rule"), "key", F.col("n").cast("string").alias("detail")))


def index_problems_in_blocks(stored: DataFrame, rebuilt: DataFrame, stored_tree: DataFrame | None = None) -> DataFrame:
    """The rows of ``index_problems``, found by digest trees: only rows of blocks that differ are joined. ``stored_tree`` is the
    tree that was written with the index, if there is one: then of the stored side only those blocks' rows are used."""
    columns = rebuilt.columns
    tree = lambda rows: materialize(digest_tree.tree(rows, "id", columns), "digests")  # noqa: E731  as many rows as nodes
    leaves, _ = digest_tree.differing_leaves(tree(stored) if stored_tree is None else stored_tree, tree(rebuilt))
    return index_problems(digest_tree.only_leaves(stored, "id", leaves), digest_tree.only_leaves(rebuilt, "id", leaves))


def index_or_rebuilt(stored: DataFrame | None, rebuilt: DataFrame) -> tuple[DataFrame, bool]:
    """The stored index if it is whole and fresh, else the one built afresh; and which."""
    if stored is not None and index_problems(stored, rebuilt).isEmpty():
        return stored, True
    return rebuilt, False


def catalogue_index(rows: DataFrame, path: str, check: bool = False) -> bool:
    """The search index artefact of a small catalogue: id to citing ids, count and text."""
    papers = {r["id"]: {"citedBy": r["cited_by"], "incomingCitationCount": len(r["cited_by"]), "searchText": r["text"]} for r in rows.orderBy("id").collect()}
    body = {"schemaVersion": 2, "catalogDigest": f"sha256:{digest(papers)}", "paperCount": len(papers), "edgeCount": sum(p["incomingCitationCount"] for p in papers.values()), "papers": papers}
    return write_or_check(path, body, check)


def json_text(c: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(c))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def catalogue_parts(rows: DataFrame, path: str, parts: int | None = None) -> dict:
    """The search index artefact of a catalogue of any size, from ``rows(id, cited_by, text)`` with distinct ids.

    Entries are written in order of their ids as part files; a head and a foot stand beside them, and a manifest names all with
    their digests. Joined in its order they are the artefact. Only the manifest, a line a part, is made on the driver.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(rows.select("id", "cited_by", "text"), "catalogue")
    whole = held.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("cited_by")), F.lit(0)).alias("edges"), F.max("id").alias("last")).first()
    root = digest_tree.tree(held, "id", ["id", "cited_by", "text"]).where("level = 0").first()
    named = {"schemaVersion": 2, "catalogDigest": f"sha256:{digest(root['digest'] if root else '')}", "paperCount": whole["n"], "edgeCount": whole["edges"], "papers": {}}
    body = json.dumps(named, indent=2, ensure_ascii=False)
    head, foot = (body[:-4] + "{\n", "  }\n}\n") if whole["n"] else (body + "\n", "")
    cited = F.array_join(F.transform("cited_by", lambda c: F.concat(F.lit(" " * 8), json_text(c))), ",\n")
    by = F.when(F.size("cited_by") == 0, "[]").otherwise(F.concat(F.lit("[\n"), cited, F.lit("\n      ]")))
    entry = F.concat(
        F.lit("    "), json_text(F.col("id")), F.lit(': {\n      "citedBy": '), by, F.lit(',\n      "incomingCitationCount": '), F.size("cited_by").cast("string"),
        F.lit(',\n      "searchText": '), json_text(F.col("text")), F.when(F.col("id") == whole["last"], "\n    }").otherwise("\n    },"),
    )
    held.repartitionByRange(n, "id").sortWithinPartitions("id").select(entry.alias("value")).write.text(f"{path}/papers")
    shared = Shared(spark, path)
    shared.write(f"{path}/head", head)
    shared.write(f"{path}/foot", foot)
    name = F.regexp_extract("path", r"[^/]+$", 0)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/papers").select(name.alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    made = [{"name": f"papers/{r['name']}", "bytes": r["length"], "sha256": r["sha256"]} for r in files.where("length > 0").orderBy("name").collect()]
    ends = [{"name": k, "bytes": len(v.encode()), "sha256": hashlib.sha256(v.encode()).hexdigest()} for k, v in (("head", head), ("foot", foot))]
    manifest = {"catalogDigest": named["catalogDigest"], "parts": [ends[0], *made, ends[1]]}
    shared.write(f"{path}/manifest.json", json.dumps(manifest))
    return manifest


def catalogue_is(rows: DataFrame, manifest: dict) -> bool:
    """Whether a written catalogue holds ``rows``: their digests are summed where they lie, nothing is written."""
    root = digest_tree.tree(rows, "id", ["id", "cited_by", "text"]).where("level = 0").first()
    return manifest["catalogDigest"] == f"sha256:{digest(root['digest'] if root else '')}"
