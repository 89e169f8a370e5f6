"""Text functions over columns. Native expressions, but for Unicode folding Spark has no expression for."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns: paper identifiers, where they stand in links and texts, the hosts whose paths hold them, names
#: that a line end has split, and reference labels.
ID_BODY = r"(?:\d{4}\.\d{4,5}|[a-z][a-z0-9.\-]+/\d{7})"
VERSION = r"(?:v\d+)?"
HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org")
PATH_ID = rf"(?i)/(?:abs|pdf|html)/({ID_BODY}{VERSION})(?:\.pdf)?/?$"
ID_PREFIX = r"(?i)^https?://(?:www\.)?arxiv\.org/(?:abs|pdf)/"
DOI_ID = rf"(?i)/arxiv\.({ID_BODY}{VERSION})(?:[/?#]|$)"
LABELLED_ID = rf"(?i)\barxiv\s*[:.]\s*({ID_BODY}{VERSION})(?![a-z0-9/])"
BARE_ID = rf"(?i)(?<![a-z0-9.\-])({ID_BODY}{VERSION})(?![a-z0-9/])"
SPLIT_NAME = r"(?i)\b([a-z][a-z0-9.]*-)\s+([a-z][a-z0-9.\-]*/\d{7}(?:v\d+)?)\b"
REFERENCE_LABEL = r"^\s*\[[^\]]+\]\s*"
LEADING_JOINER = r"(?i)^(?:&|and\b|or\b)"


@lru_cache(maxsize=2)
def marks(first: int, last: int) -> re.Pattern:
    """Runs of combining marks between two code points, as a class made from the character database."""
    points = [c for c in range(first, last) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for c, before in zip(points, [-2, *points]) if c != before + 1]
    ends = [c for c, after in zip(points, [*points[1:], -2]) if after != c + 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in zip(starts, ends)) + "]+")


HIGH = re.compile("[\U00010000-\U0010ffff]")
OTHERS = re.compile(r"[\W_]+")
PLAIN = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(128)


def fold(x: str) -> str:
    """NFKD, marks dropped, lower case, everything but letters and numbers to single spaces."""
    # two classes: one of code points below 2^16 is a bit table, one with higher ones a list that each letter runs through
    x = marks(0, 1 << 16).sub("", unicodedata.normalize("NFKD", x))
    if HIGH.search(x):
        x = marks(1 << 16, 0x110000).sub("", x)
    x = x.lower()
    if x.isascii():
        return b" ".join(x.encode().translate(PLAIN).split()).decode()
    return OTHERS.sub(" ", x).strip()


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold, na_action="ignore")


def normalize_search_text(c: Column) -> Column:
    """NFKD, marks dropped, lower case, everything but letters and numbers to single spaces; null gives ''. ASCII text, to
    which the first two do nothing, never leaves the JVM."""
    plain = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    other = c.rlike(r"[^\x00-\x7F]")
    return F.coalesce(F.when(other, _fold(F.when(other, c))).otherwise(plain), F.lit(""))


@F.pandas_udf(T.StringType())
def author_key(s: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed; null stays null."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def search_text(*parts: Column | str) -> Column:
    """Normalised text of several columns; arrays are joined by spaces."""
    return normalize_search_text(F.concat_ws(" ", *parts))


def collapse_spaces(c: Column) -> Column:
    # a space on its own stays as it is
    return F.trim(F.regexp_replace(c, r" \s++|[\t\n\x0B\f\r]\s*+", " "))


def strip_descriptor(c: Column, label: str) -> Column:
    return F.trim(F.regexp_replace(c, rf"^{label}:\s*", ""))


def split_list(c: Column, separators: str = ",;") -> Column:
    """Parts between separators, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(c, f"[{separators}]"), lambda x: F.trim(x)), lambda x: x != "")


def strip_reference_label(c: Column) -> Column:
    return F.regexp_replace(c, REFERENCE_LABEL, "")


def normalize_id(c: Column) -> Column:
    """struct<id, version>: URL, prefix, query, fragment, suffix and slashes dropped; null where
    what is left is no identifier."""
    c = F.trim(c)
    c = F.regexp_replace(c, ID_PREFIX, "")
    c = F.regexp_replace(c, r"(?i)^arxiv:", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[?].*$", ""), r"#.*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)\.pdf$", ""), r"^/+|/+$", "")
    whole = rf"(?i)^({ID_BODY})(?:v(\d+))?$"
    ok = c.rlike(whole)
    version = F.regexp_extract(c, whole, 2)
    return F.struct(
        F.when(ok, F.lower(F.regexp_extract(c, whole, 1))).alias("id"),
        F.when(ok & (version != ""), version.cast("int")).alias("version"),
    )


def _versionless(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?i)v\d+$", ""))


def ids_from_href(c: Column) -> Column:
    """array<string>: identifiers (versionless, lower case) in a link: its path if the host is one of HOSTS or there is
    none, its DOI, and labelled ones anywhere. Percent signs are decoded first."""
    decoded = F.coalesce(F.try_url_decode(F.replace(F.trim(c), F.lit("+"), F.lit("%2B"))), F.trim(c))
    host = F.lower(F.regexp_extract(decoded, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(decoded, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*", ""), r"[?#].*$", "")
    own = F.when((host == "") | host.isin(*HOSTS), F.regexp_extract(path, PATH_ID, 1)).otherwise("")
    found = F.concat(F.array(own, F.regexp_extract(path, DOI_ID, 1)), F.regexp_extract_all(decoded, F.lit(LABELLED_ID), 1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), _versionless)))


def id_from_href(c: Column) -> Column:
    """The first of ``ids_from_href``, or null."""
    return F.get(ids_from_href(c), F.lit(0))


def bare_ids(c: Column) -> Column:
    """Identifiers that stand alone in text, labelled or bare, sorted and distinct. Split archive names
    are joined first."""
    joined = F.regexp_replace(c, SPLIT_NAME, "$1$2")
    found = F.concat(*[F.regexp_extract_all(joined, F.lit(p), 1) for p in (BARE_ID, LABELLED_ID)])
    return F.array_sort(F.array_distinct(F.transform(found, _versionless)))


def is_substantive(c: Column, hrefs: Column | None = None) -> Column:
    """A reference item with text besides its label that is no reverse-citation line, or without text but with a link
    that leaves the page."""
    text = F.trim(strip_reference_label(c))
    leaves = F.exists(hrefs, lambda h: ~F.startswith(F.trim(h), F.lit("#"))) if hrefs is not None else F.lit(False)
    return F.when(text.rlike(r"(?i)^cited by:"), False).when(text != "", True).otherwise(leaves)


def alias_ids(c: Column, aliases: dict[str, str]) -> Column:
    """array<string>: ids of ``aliases`` (title: id) whose title stands in the text, case and white space aside."""
    low = F.lower(collapse_spaces(c))
    hits = [F.when(F.contains(low, F.lit(" ".join(t.lower().split()))), F.lit(i)) for t, i in sorted(aliases.items())]
    return F.array_distinct(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")


def search_url(base: str, query: Column, start: Column, size: int = 50) -> Column:
    """A result page, newest first."""
    parts = (("query", F.url_encode(query)), ("order", F.lit("-announced_date_first")), ("size", F.lit(str(size))), ("start", start.cast("string")))
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *[F.concat(F.lit(f"{n}="), c) for n, c in parts]))


def is_newest_first(url: Column) -> Column:
    """Whether a result page asks for the order that a frontier needs."""
    return F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("order")) == "-announced_date_first", F.lit(False))


def catch_up_url(base: str, archive: Column, day: Column) -> Column:
    return F.concat(F.lit(f"{base}/"), F.url_encode(archive), F.lit("/"), F.date_format(day, "yyyy-MM-dd"))


def page_url(site: str, *path: Column) -> Column:
    """An absolute address below the site's root, its segments encoded, with a closing slash."""
    return F.concat(F.lit(site.rstrip("/") + "/"), *[F.concat(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("/")) for p in path])


def author_label(names: Column, most: int = 4, most_chars: int = 80) -> Column:
    """A collaboration's name; else one or two names; else up to ``most`` short ones; else "X et al."."""
    names = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != "")
    group = F.get(F.filter(names, lambda x: x.rlike(r"(?i)\b(?:collaboration|consortium)\b")), F.lit(0))
    whole, n = F.array_join(names, ", "), F.size(names)
    short = (n <= 2) | ((n <= most) & (F.length(whole) <= most_chars))
    return F.when(group.isNotNull(), group).when(n == 0, F.lit(None).cast("string")).when(short, whole).otherwise(
        F.concat(F.get(names, F.lit(0)), F.lit(" et al."))
    )


def wrap_label(c: Column, per_char: float = 7.4, padding: float = 8, single: float = 168) -> Column:
    """array<string> of one or two lines: the split of least maximum width, then without a leading joiner,
    then most even, then earliest."""
    c = collapse_spaces(c)
    words = F.split(c, " ")
    width = lambda x: F.length(x) * F.lit(float(per_char)) + F.lit(float(padding))

    def option(i: Column) -> Column:
        a = F.array_join(F.slice(words, 1, i), " ")
        b = F.array_join(F.slice(words, i + 1, F.size(words)), " ")
        joiner = F.when(b.rlike(LEADING_JOINER), 1).otherwise(0)
        return F.struct(
            F.greatest(width(a), width(b)).alias("w"), joiner.alias("j"), F.abs(F.length(a) - F.length(b)).alias("d"),
            i.alias("i"), a.alias("a"), b.alias("b"),
        )

    one = (F.size(words) < 2) | (width(c) <= single)
    options = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), option)
    best = F.array_min(options)
    return F.when(one, F.array(c)).otherwise(F.array(best["a"], best["b"]))


#: Fixed label sizes: least width, padding, height of one line and of each further one, widths of a title's and a kicker's letter.
LEAST_WIDTH, LABEL_PADDING, ONE_LINE, NEXT_LINE, TITLE_LETTER, KICKER_LETTER = 92.0, 8.0, 34.0, 16.0, 7.4, 5.5


def label_box(title: Column, kicker: Column) -> Column:
    """struct<lines, width, height> of a label: its wrapped title above a kicker."""
    lines = wrap_label(title, TITLE_LETTER, LABEL_PADDING)
    widest = F.array_max(F.transform(lines, F.length)) * F.lit(TITLE_LETTER) + F.lit(LABEL_PADDING)
    below = F.length(collapse_spaces(F.coalesce(kicker, F.lit("")))) * F.lit(KICKER_LETTER) + F.lit(LABEL_PADDING)
    height = F.lit(ONE_LINE) + (F.size(lines) - 1) * F.lit(NEXT_LINE)
    return F.struct(lines.alias("lines"), F.greatest(F.lit(LEAST_WIDTH), widest, below).alias("width"), height.alias("height"))


#: Fixed entity names, in the order in which they are decoded: the ampersand first.
ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "))


def decode_entities(c: Column) -> Column:
    """Named entities, then numeric ones; what is no code point stays as it is."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  a lambda's variable stands for the text, so that it isn't worked out again at each mention

    def named(x: Column) -> Column:
        for name, char in ENTITIES:
            x = F.replace(x, F.lit(name), F.lit(char))
        return once(x, lambda y: F.when(F.contains(y, F.lit("&#")), numbered(y)).otherwise(y))

    def numbered(x: Column) -> Column:
        for start, digits, base in (("&#x", "[0-9a-fA-F]{1,6}", 16), ("&#X", "[0-9a-fA-F]{1,6}", 16), ("&#", "[0-9]{1,7}", 10)):
            x = once(x, lambda y: F.when(F.contains(y, F.lit(start)), _numeric(y, start, digits, base)).otherwise(y))  # noqa: B023
        return x

    return once(c, lambda x: F.when(F.contains(x, F.lit("&")), named(x)).otherwise(x))


def _numeric(c: Column, start: str, digits: str, base: int) -> Column:
    def char(p: Column) -> Column:
        found = F.regexp_extract(p, f"^({digits});", 1)
        point = F.conv(found, base, 10).cast("long")
        known = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        raw = F.unhex(F.lpad(F.hex(F.when(known, point)), 8, "0"))
        return F.coalesce(F.concat(F.decode(raw, "UTF-32"), F.substr(p, F.length(found) + 2)), F.concat(F.lit(start), p))

    parts = F.split(c, start)
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), char)
    return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))


def visible_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, entities decoded, spaces collapsed. The patterns never go
    back over what they have read."""
    body = r"<{0}\b[^>]*+>[^<]*+(?:<(?!/{0}>)[^<]*+)*+</{0}>"
    c = F.regexp_replace(html, f"(?i){body.format('script')}|{body.format('style')}", " ")
    c = F.regexp_replace(c, r"<!--[^-]*+(?:-(?!->)[^-]*+)*+-->", " ")
    c = F.regexp_replace(c, r"<[^>]*+>", " ")
    return collapse_spaces(decode_entities(c))


#: Fixed XML escapes, the ampersand first.
XML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def escape_xml(c: Column) -> Column:
    for char, name in XML:
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def escape_json_ld(c: Column) -> Column:
    """JSON that is safe inside a script element."""
    for char, name in (("<", "\\u003c"), (" ", "\\u2028"), (" ", "\\u2029")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_ld_types(s: pd.Series) -> pd.Series:
    """All @type values of a JSON-LD document, at any depth, sorted and distinct; null for what is no JSON."""

    def one(x):
        try:
            todo, found = [json.loads(x)], set()
        except (TypeError, ValueError):
            return None
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                kind = node.get("@type", [])
                found |= {k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)}
                todo += node.values()
            elif isinstance(node, list):
                todo += node
        return sorted(found)

    return s.map(one)


def truncate_words(c: Column, most: int = 158) -> Column:
    """At most ``most`` characters: cut before the last space and closed with an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, most - 1), r"\s+\S*$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("…")))


def enum_label(c: Column, labels: dict[str, str], default: str = "other") -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), F.lit(labels.get(default, default)))


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the named columns in name order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def relevance(c: Column, subject: str, word: str, phrases: tuple[str, ...]) -> Column:
    """(subject or word on its own) and any phrase, in lower case with "--" read as "-"."""
    c = F.replace(F.lower(c), F.lit("--"), F.lit("-"))
    any_phrase = F.lit(False)
    for p in phrases:
        any_phrase = any_phrase | F.contains(c, F.lit(p))
    return (F.contains(c, F.lit(subject)) | c.rlike(rf"\b{word}\b")) & any_phrase
