"""Near-duplicate classes by BagMinHash signatures over word shingles.

A text is the multiset of its five-word shingles (one shorter shingle where it has fewer words).
BagMinHash: the weight axis of a shingle is cut into [0, 1), [1, 2), [2, 4), [4, 8) and so on. Each interval has
a Poisson process whose rate is its width; a point has a time and a signature component. An interval
inside the shingle's weight counts its first point; then it is split into halves, a coin gives
the point to one of them, the other draws its own first point after that time, and halves that lie
above the weight are dropped. Intervals of width 1 draw all their further points. A component keeps
its earliest time, so two components agree with probability equal to the weighted Jaccard similarity.
Whole subtrees whose first point comes after every component's time are never opened, so the
cost is logarithmic in the weights.

Bands of components give buckets. Links come in two rounds, each verified on the exact multisets:

1. each text with the most central text of its buckets (the one that shares buckets with most others);
2. texts of buckets that still hold several classes: two texts of different classes that share a
   bucket are tested if they share a token of their prefixes. A token is a shingle with the number of its
   copy; tokens are ordered by rarity (those of one class first, then by count), and a pair at the wanted similarity
   has at least t / (1 + t) (m + n) tokens in common, so the first m - that + 1 of one text and n - that + 1 of the other
   can't be disjoint. Nothing that reaches the similarity is lost, and texts that differ by edits of their
   own share no such token. Where texts share a template and stay just below the similarity, their prefixes meet in its
   tokens; then odd sketches decide: a bit of a sketch is the parity of the tokens that hash to it, so two sketches
   differ in at most as many bits as their token sets have unlike tokens, of which a pair at the similarity
   has (1 - t) / (1 + t) (m + n) at most. That test, in the join itself, costs some words a pair and loses none; pairs
   it leaves are tested for a shared bucket and by wider sketches before any tokens move.

Pairs inside one class need no test, so no class loses a link.

Defined results: null is the empty text; texts with the same words are one class (so are those
without words); a class id is its smallest doc_id; repeated rows each get a row; rows that share a doc_id but not
their words each get the result of their own words; a text of any length is hashed whole, in chunks; an empty table gives none;
other columns are ignored.
A null doc_id never stands for its words: such a row gets the result of the smallest real id with the same
words and, if there is none, null for copy_of and class_id and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.filters import in_filter, key_filter
from folioscope.session import ensure_workers, materialize

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 30, 6
GOLD = np.uint64(0x9E3779B97F4A7C15)
SEEDS = np.arange(64, dtype=np.uint64) * GOLD

# word hashes: sums of a letter's number times a power of STEP by its place in the word
STEP, CHUNK, LONG = 0xD6E8FEB86659FD93, 1 << 16, 1024
#: Sizes n >= m of a pair are classed by n / m; the narrower a class, the shorter its prefixes.
RATIOS = (1.0, 1.01, 1.03, 1.08)
#: Bits of the sketch that each prefix row carries, and prefix rows of one token that one key takes.
CARRIED, HOT = 1024, 2048


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * GOLD)
POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK, STEP, np.uint64)]))
BACK = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK, pow(STEP, -1, 1 << 64), np.uint64)]))


def word_hashes(joined: bytes) -> np.ndarray:
    """Hashes of words parted by one newline each, chunk by chunk; a word of more than LONG bytes by xxh3."""
    out, at = [], 0
    while at < len(joined):
        end = len(joined) if len(joined) - at <= CHUNK else joined.rfind(b"\n", at, at + CHUNK)
        if end < 0:  # one word fills the chunk
            end = joined.find(b"\n", at)
            end = len(joined) if end < 0 else end
            out.append(np.array([xxhash.xxh3_64_intdigest(joined[at:end])], np.uint64))
        else:
            part = np.frombuffer(joined, np.uint8, end - at, at)
            stops = np.append(np.flatnonzero(part == 10), len(part))
            starts = np.concatenate([[0], stops[:-1] + 1])
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(LETTER[part] * POWER[: len(part)], out=sums[1:])
            lengths = stops - starts
            hashes = mix64((sums[stops] - sums[starts]) * BACK[starts] + lengths.astype(np.uint64))
            for k in np.flatnonzero(lengths > LONG):
                hashes[k] = xxhash.xxh3_64_intdigest(part[starts[k] : stops[k]].tobytes())
            out.append(hashes)
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | bytes | None, width: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """A digest of the word sequence, and the hashes of all shingles in order."""
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    joined = b"\n".join(raw.split())
    ids = word_hashes(joined)
    digest = xxhash.xxh3_128_digest(joined)
    if not len(ids):
        return digest, ids
    n = max(1, len(ids) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(ids))):
        out = mix64(out * GOLD + ids[k : k + n] + np.uint64(k))
    return digest, out


def points(random: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponential gaps of rate 1 in units of 2^-44, as integers so that sums don't depend on their order, and components."""
    gap = np.log((random >> np.uint64(32)).astype(np.float64) * 2.0**-32 + 2.0**-33) * -(2.0**44)
    return gap.astype(np.int64), ((random & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def split(seed, start, weight, halvings, least) -> tuple[np.ndarray, np.ndarray]:
    """Opens the processes of wide intervals level by level into ``least``: the seeds and times at which those
    of width 1 go on."""
    size = len(least)
    gap, part = points(mix64(seed + GOLD), size)
    time = gap >> halvings
    seeds, times = [], []
    while len(seed):
        width = np.int64(1) << halvings
        inside = start + width <= weight
        np.minimum.at(least, part[inside], time[inside])
        stay = time < least.max()
        seed, start, weight, halvings, time, part, width = (x[stay] for x in (seed, start, weight, halvings, time, part, width))
        done = halvings == 0
        seeds.append(mix64(seed[done] + SEEDS[2]))
        times.append(time[done])
        seed, start, weight, halvings, time, part, width = (x[~done] for x in (seed, start, weight, halvings, time, part, width))
        upper = (mix64(seed + SEEDS[3]) >> np.uint64(63)).astype(bool)
        halves = []
        for side in (0, 1):
            child, low = mix64(seed + SEEDS[4 + side]), start + side * (width >> 1)
            gap, own = points(mix64(child + GOLD), size)
            mine = upper == bool(side)
            at = np.where(mine, time, time + (gap >> (halvings - 1)))
            keep = low < weight
            halves.append([x[keep] for x in (child, low, weight, halvings - 1, at, np.where(mine, part, own))])
        seed, start, weight, halvings, time, part = (np.concatenate(x) for x in zip(*halves))
    return np.concatenate(seeds), np.concatenate(times)


def bag_min_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Earliest times by component, as 64-bit words."""
    least = np.full(size, np.iinfo(np.int64).max)
    if not len(hashes):
        return least.view(np.uint64)
    keys, weights = np.unique(hashes, return_counts=True)
    seeds, times = [mix64(keys)], [np.zeros(len(keys), np.int64)]
    more, wide, low, level = weights > 1, [], 1, 0
    while more.any():  # an interval [low, 2 low) has a seed of its own
        keys, weights = keys[more], weights[more]
        seed = mix64(keys + SEEDS[level + 8])
        if low == 1:
            seeds.append(seed)
            times.append(np.zeros(len(seed), np.int64))
        else:
            wide.append((seed, np.full(len(seed), low), weights, np.full(len(seed), level)))
        low, level = low * 2, level + 1
        more = weights > low
    if wide:
        seed, time = split(*(np.concatenate(x) for x in zip(*wide)), least)
        seeds.append(seed)
        times.append(time)
    seed, time, step = np.concatenate(seeds), np.concatenate(times), 0
    while len(seed):
        # several points of each process at a time, about as many as fill the components
        ahead = int(min(64, max(1, 3 * size // len(seed))))
        turns = np.arange(step + 1, step + 1 + ahead, dtype=np.uint64) * GOLD
        step += ahead
        gap, part = points(mix64(seed[:, None] + turns), size)
        if ahead > 1:
            gap = np.cumsum(gap, axis=1)
        gap += time[:, None]
        np.minimum.at(least, part.ravel(), gap.ravel())
        time = gap[:, -1]
        stay = time < least.max()
        seed, time = seed[stay], time[stay]
    return least.view(np.uint64)


def tokens(hashes: np.ndarray) -> np.ndarray:
    """The multiset as a set: a shingle's first copy is its hash, each further one that hash mixed with its number."""
    keys, weights = np.unique(hashes, return_counts=True)
    again = np.repeat(keys, weights - 1)
    number = np.arange(len(again)) - np.repeat(np.cumsum(weights - 1) - (weights - 1), weights - 1) + 1
    return np.concatenate([keys, mix64(again + number.astype(np.uint64) * GOLD)])


def odd_sketch(found: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Parities of the tokens by hash as words; where ``bits`` isn't given, of at least eight bits a token. A shorter sketch is
    a longer one whose halves are xored."""
    bits = bits or max(64, 1 << (8 * max(1, len(found)) - 1).bit_length())
    parity = np.bincount(((found >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = mix64(key * GOLD + parts[:, k])
    return key.view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(tokens(a), tokens(b), assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, size, keys) for each row."""
    ensure_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, keys = [], [], []
            for text in b.column(1).cast(pa.binary()):
                digest, hashes = shingles(text.as_py())
                digests.append(digest)
                sizes.append(len(hashes))
                keys.append(band_keys(bag_min_hash(hashes, bands * rows), bands, rows) if len(hashes) else np.zeros(0, np.int64))
            arrays = [b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists(keys)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "size", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, digest binary, size long, keys array<long>")


def bags(docs: DataFrame) -> DataFrame:
    """(digest, tokens, odd, wide) for each row: ``odd`` and ``wide`` are its sketches, of CARRIED bits and by its size."""
    ensure_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [shingles(text.as_py()) for text in b.column(0).cast(pa.binary())]
            found = [tokens(h) for _, h in both]
            sketches = [[odd_sketch(t, bits) for t in found] for bits in (CARRIED, None)]
            arrays = [pa.array([d for d, _ in both], pa.binary()), lists([t.view(np.int64) for t in found]), *map(lists, sketches)]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "tokens", "odd", "wide"])

    return docs.select("text").mapInArrow(run, "digest binary, tokens array<long>, odd array<long>, wide array<long>")


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def verified(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs in ``left`` (a, b, size, keys, tokens of b) whose texts share a bucket and reach ``similarity``;
    ``right`` has a's node, size, keys and tokens. One shuffle of each side."""
    one, two = left.alias("one"), right.alias("two")
    joined = one.join(two, F.col("one.a") == F.col("two.node"))
    both = F.size(F.array_intersect("one.tokens", "two.tokens"))
    near = joined.where(F.arrays_overlap("one.keys", "two.keys")).select(
        "a", "b", (both / (F.col("one.size") + F.col("two.size") - both)).alias("similarity")
    )
    return near.where(F.col("similarity") >= similarity).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable. Smallest-neighbour steps with pointer jumping; each step is
    a written table, and their number follows the logarithm of a class's diameter."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    label = nodes.select("id", F.col("id").alias("comp"))
    while True:
        near = both.join(label.select(F.col("id").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        stepped = label.join(near, F.col("id") == F.col("x"), "left").select(
            "id", "comp", F.least("comp", F.coalesce("near", "comp")).alias("next")
        )
        jumped = stepped.join(
            label.select(F.col("id").alias("next"), F.col("comp").alias("further")), "next", "left"
        ).select("id", "comp", F.least("next", F.coalesce("further", "next")).alias("next"))
        table = materialize(jumped, "components")
        label = table.select("id", F.col("next").alias("comp"))
        if table.where("comp <> next").isEmpty():
            return label


def merge_classes(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label(id, comp)`` with the classes joined that ``links(a, b)`` connect. Only pairs of classes go through
    ``components``, so later rounds work on what is still apart."""
    side = lambda c: label.select(F.col("id").alias(c), F.col("comp").alias(f"class_{c}"))
    apart = links.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("class_a <> class_b")
    pairs = materialize(apart.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct(), "class-pairs")
    if pairs.isEmpty():
        return label
    nodes = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    joined = components(nodes, pairs).select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    return materialize(label.join(joined, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "classes")


def fits(x: str, y: str, similarity: float) -> F.Column:
    """Whether texts of these sizes can reach ``similarity``."""
    return F.least(x, y) >= F.lit(similarity) * F.greatest(x, y)


def unlike_carried(one: str, two: str) -> F.Column:
    """As ``unlike`` for sketches of CARRIED bits, in generated code."""
    return sum(F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(two, F.lit(k)))) for k in range(CARRIED // 64))


def unlike(small: str | F.Column, large: str | F.Column) -> F.Column:
    """Bits in which two sketches differ, the longer one folded once: no more than the tokens that only one text has."""
    small, large = (F.col(c) if isinstance(c, str) else c for c in (small, large))
    half = F.size(small)
    xor = lambda x, y: x.bitwiseXOR(y)
    folded = F.zip_with(F.slice(large, F.lit(1), half), F.slice(large, half + 1, half), xor)
    same = F.when(F.size(large) == half, large).when(F.size(large) == 2 * half, folded)
    # sizes too far apart for one fold give null: nothing is known then
    return F.coalesce(F.aggregate(F.zip_with(small, same, xor), F.lit(0), lambda n, x: n + F.bit_count(x)), F.lit(0))


def most_unlike(m: str, n: str, similarity: float) -> F.Column:
    """Tokens that only one of two texts of these sizes has, at most, where they reach ``similarity``."""
    return F.lit((1 - similarity) / (1 + similarity)) * (F.col(m) + F.col(n)) + 1e-6


def close_pairs(pairs: DataFrame, kept: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that share a bucket and whose full sketches let them reach ``similarity``; ``kept`` has node, size,
    keys and wide."""
    side = lambda c: kept.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("size", "keys", "wide")])
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("keys_a", "keys_b"))
    first = F.col("size_a") <= F.col("size_b")
    small, large = (F.when(first, F.col(f"wide_{x}")).otherwise(F.col(f"wide_{y}")) for x, y in (("a", "b"), ("b", "a")))
    return joined.where(unlike(small, large) <= most_unlike("size_a", "size_b", similarity)).select("a", "b")


def prefix_pairs(apart: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``apart`` (node, comp, size, tokens and, if there, odd), of different classes, that share a token of
    their prefixes and whose sketches let them reach ``similarity``. Rows of a token with more than HOT texts are dealt over
    several keys.

    Tokens that occur in one class only are first in every order and can't be shared between classes, so just
    their number counts; the others are ordered by their number of texts and themselves.
    """
    every = apart.select("node", "comp", F.explode("tokens").alias("token"))
    shared = every.groupBy("token").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    kept = every.select("node", "token").join(shared.select("token", "n"), "token")
    order = kept.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared"))
    sketch = [c for c in ("odd",) if c in apart.columns]
    ranked = materialize(order.join(apart.select("node", "comp", "size", *sketch), "node"), "prefixes")
    own = F.col("size") - F.size("shared")
    part = similarity / (1 + similarity)

    def rows(name: str, least_common) -> DataFrame:
        """(kind, token) for each class of sizes with the tokens of the prefix for it."""
        classes = []
        for k, (low, high) in enumerate(zip(RATIOS, (*RATIOS[1:], 1 / similarity))):
            common = F.ceil(least_common(low, high) - F.lit(1e-6))
            prefix = F.greatest(F.size("shared") * 0, (F.col("size") - common + 1 - own).cast("int"))
            classes.append(F.transform(F.slice("shared", F.lit(1), prefix), lambda t: F.struct(F.lit(k).alias("kind"), t["token"].alias("token"), t["n"].alias("n"))))  # noqa: B023
        each = ranked.select("node", "comp", "size", *sketch, F.explode(F.flatten(F.array(*classes))).alias("at")).select(
            "node", "comp", "size", *sketch, "at.kind", "at.token", (1 + F.floor(F.col("at.n") / HOT)).cast("int").alias("parts")
        )
        part_of = F.pmod(F.xxhash64("node"), "parts").cast("int") if name == "held" else F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        return each.withColumn("part", part_of).alias(name)

    # the smaller text of a pair is held by its own prefix, the larger one asks for it
    held = rows("held", lambda low, high: part * (1 + low) * F.col("size"))
    asks = rows("asks", lambda low, high: part * (1 + 1 / high) * F.col("size"))
    m, n = F.col("held.size"), F.col("asks.size")
    ratio = n / m
    kind = sum((ratio >= F.lit(r)).cast("int") for r in RATIOS[1:])
    same = [F.col(f"held.{c}") == F.col(f"asks.{c}") for c in ("kind", "token", "part")]
    met = held.join(asks, same).where(
        (F.col("held.comp") != F.col("asks.comp"))
        & ((m < n) | ((m == n) & (F.col("held.node") < F.col("asks.node"))))
        & (m >= F.lit(similarity) * n)
        & (kind == F.col("held.kind"))
        & (unlike_carried("held.odd", "asks.odd") <= most_unlike("held.size", "asks.size", similarity) if sketch else F.lit(True))
    )
    return met.select(F.least("held.node", "asks.node").alias("a"), F.greatest("held.node", "asks.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, copy_of, class_id, n_tested_links), one for each row of ``docs``: ``copy_of`` is the smallest doc_id
    with the same words, ``class_id`` the smallest of the class, ``n_tested_links`` the verified links that text
    has; pairs that were in one class by other links aren't tested, so it is a lower bound of its links."""
    sigs = materialize(signatures(docs, bands, rows), "signatures")
    first = F.min(F.struct("doc_id", "size", "keys")).alias("r")
    distinct = sigs.where("doc_id is not null").groupBy("digest").agg(first)
    reps = materialize(distinct.select(F.monotonically_increasing_id().alias("node"), "digest", "r.*"), "distinct")

    keyed = reps.select("node", "size", F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    open_ = materialize(keyed.join(several, "key"), "buckets")
    score = open_.groupBy("node").agg(F.sum("n").alias("score"))
    scored = materialize(open_.join(score, "node").select("key", "node", "size", "score"), "scored")
    top = F.max(F.struct("score", (-F.col("node")).alias("minus"), F.col("size").alias("leader_size")))
    leaders = scored.groupBy("key").agg(top.alias("top")).select("key", (-F.col("top.minus")).alias("leader"), "top.leader_size", F.col("top.score").alias("height"))
    chosen = F.max(F.struct("height", (-F.col("leader")).alias("minus")))
    nearest = scored.join(leaders, "key").where(F.col("leader") != F.col("node")).where(fits("size", "leader_size", similarity)).groupBy("node").agg(
        chosen.alias("c")
    )
    stars = materialize(nearest.select("node", (-F.col("c.minus")).alias("leader")), "stars")
    led = stars.select(F.col("leader").alias("node")).distinct().withColumn("leads", F.lit(True))
    members = materialize(reps.join(score.select("node"), "node").join(stars, "node", "left").join(led, "node", "left"), "members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = texts.join(F.broadcast(key_filter(members, "doc_id")), in_filter("doc_id"), "left_semi")
    held = bags(wanted).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("tokens", "odd", "wide")])
    kept = materialize(held.join(members, "digest").select("node", "size", "keys", "leader", "leads", "tokens", "odd", "wide"), "bags")

    star = kept.where("leader is not null").select(F.col("leader").alias("a"), F.col("node").alias("b"), "size", "keys", "tokens")
    links = materialize(verified(star, kept.where("leads").select("node", "size", "keys", "tokens"), similarity), "links")
    label = merge_classes(members.select(F.col("node").alias("id"), F.col("node").alias("comp")), links)

    now = open_.select("key", F.col("node").alias("id")).join(label, "id")
    mixed = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    still = materialize(now.join(mixed.select("key"), "key", "left_semi").groupBy("id").agg(F.first("comp").alias("comp")), "apart")
    apart = kept.select("node", "size", "tokens", "odd").join(still.withColumnRenamed("id", "node"), "node")
    pairs = materialize(close_pairs(prefix_pairs(apart, similarity), kept, similarity), "pairs")
    with_b = pairs.join(kept.select(F.col("node").alias("b"), "size", "keys", "tokens"), "b")
    late = materialize(verified(with_b, kept.select("node", "size", "keys", "tokens"), similarity), "links")
    label = merge_classes(label, late)

    ends = links.union(late).distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_tested_links"))
    named = label.withColumnRenamed("id", "node").join(members.select("node", "doc_id"), "node")
    names = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    classes = named.select("node", "comp").join(names, "comp").join(ends, "node", "left").select("node", "class_id", "n_tested_links")
    known = reps.select("digest", "node", F.col("doc_id").alias("copy_of")).join(classes, "node", "left")
    every = sigs.select("doc_id", "digest").join(known, "digest", "left")
    return every.select(
        "doc_id", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("n_tested_links", F.lit(0)).cast("long").alias("n_tested_links")
    )
