"""BPE encoding and decoding as streaming transducers.

``MergeTable`` computes from the merge list how many symbols right of a token can still decide whether it
merges with what follows: the sufficient lookahead, by token and over all. ``Transducer`` holds the
symbols after the last settled boundary, merges inside that window, and emits every token whose
lookahead is known. Memory is the window, whatever the length of a word. ``Encoder.stream`` takes a
text in pieces and holds back at most an unfinished word, of which a long one streams through the transducer
too. ``Decoder`` is the inverse machine: it takes ids one block at a time, turns them into bytes and bytes into text,
holding back at most an unfinished UTF-8 sequence.

Letters, numbers and lower case are those of the tokenizer library's own tables: each non-ASCII character is
put to its pre-tokenizer once, and words with combining marks or characters that this Python doesn't know to its normaliser.

Defined results: null and empty texts give no tokens and the empty text; repeated rows each get a
row; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from folioscope.session import ensure_workers

BLOCK = 1 << 16
#: Longer than any special token or contraction, of which a part may stand at a cut.
MARGIN = 32
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: printable Latin-1 stands for itself, the rest for
    code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class MergeTable:
    """Vocabulary and ranked merges over token ids, with the sufficient lookahead."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rule: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.rule[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.right: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.whole: list[int] = []
        for (a, b), (rank, to) in self.rule.items():
            self.right[a][b] = rank
            self.whole.append(to)
        self.none = len(self.whole)
        self.longest = 1
        self.need = self._needs()
        self.lookahead = max([1, *self.need.values()])

    def _needs(self) -> dict[int, int]:
        """By token: how many symbols right of it decide whether it merges with what follows.

        Rule q = (a, b) merges a boundary if b stands right of it at q's turn. With everything
        left of the boundary known, that is settled by b's own symbols and by whether an earlier
        rule takes a right end of b away: a rule (s, x) where s is b or one of the right parts b
        is made of, with a rank below the one at which s is itself used. So
        need(q) = len(b) + max need(those rules), in order of rank. A token needs the most of all rules that can
        take its own right ends in this way.
        """
        size: dict[int, int] = {}
        made: dict[int, list[tuple[int, int]]] = {}  # token: its right parts, with the ranks that make it
        ranks: dict[int, list[int]] = {}  # by left token: ranks of its rules so far
        best: dict[int, list[int]] = {}  # and the largest need up to each of them

        def most(token: int, before: int) -> int:
            need, todo = 0, [(token, before)]
            while todo:
                s, rank = todo.pop()
                if (r := ranks.get(s)) and (at := bisect_left(r, rank)):
                    need = max(need, best[s][at - 1])
                todo += made.get(s, ())
            return need

        for (a, b), (rank, whole) in sorted(self.rule.items(), key=lambda x: x[1][0]):
            need = most(b, rank) + size.get(b, 1)
            ranks.setdefault(a, []).append(rank)
            seen = best.setdefault(a, [])
            seen.append(max(need, seen[-1] if seen else 0))
            made.setdefault(whole, []).append((b, rank))
            size[whole] = size.get(a, 1) + size.get(b, 1)
            self.longest = max(self.longest, size[whole])
        return {t: most(t, self.none) for t in {*self.vocab.values()}}

    def merge(self, ids: list[int]) -> list[int]:
        """All merges inside ``ids``, lowest rank first, leftmost first among equals."""
        rule, right, whole, none = self.rule, self.right, self.whole, self.none
        if len(ids) <= 48:
            ranks = [right[a].get(b, none) for a, b in zip(ids, ids[1:])]
            while ranks and (top := min(ranks)) < none:
                i = ranks.index(top)
                ids[i] = to = whole[top]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = right[ids[i - 1]].get(to, none)
                if i < len(ranks):
                    ranks[i] = right[to].get(ids[i + 1], none)
            return ids
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        alive = ids[:]
        heap = [(f[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (f := rule.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if alive[i] != a or j < 0 or alive[j] != b:
                continue
            alive[i], alive[j] = rule[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if f := rule.get((alive[i], alive[after[i]])):
                    heapq.heappush(heap, (f[0], i, alive[i], alive[after[i]]))
            if (h := before[i]) >= 0 and (f := rule.get((alive[h], alive[i]))):
                heapq.heappush(heap, (f[0], h, alive[h], alive[i]))
        return [x for x in alive if x >= 0]


class Transducer:
    """Symbols in, settled tokens out. The window is merged whenever it has grown to twice what the last time
    left unsettled, and to ``block`` symbols at least."""

    def __init__(self, table: MergeTable, sizes: dict[int, int], block: int = 16):
        self.table, self.sizes, self.block = table, sizes, block
        self.full = max(block, 2 * (table.lookahead + table.longest))
        self.window: list[int] = []
        self.limit = block

    def push(self, symbols: list[int]) -> list[int]:
        if len(self.window) + len(symbols) < self.limit:
            self.window += symbols
            return []
        out, at = [], 0
        while at < len(symbols):
            room = self.limit - len(self.window)
            self.window += symbols[at : at + room]
            at += room
            if len(self.window) >= self.limit:
                out += self._settle()
                self.limit = max(self.block, 2 * len(self.window))
        return out

    def flush(self) -> list[int]:
        """The end of the word settles what is left."""
        rest, self.window, self.limit = self.table.merge(self.window), [], self.block
        return rest

    def _settle(self) -> list[int]:
        merged, need, known = self.table.merge(self.window[:]), self.table.need, 0
        for k in range(len(merged) - 1, -1, -1):
            if known and known >= need[merged[k]]:
                del self.window[: len(self.window) - known]
                return merged[: k + 1]
            known += self.sizes[merged[k]]
        return []


class Memo(dict):
    """A bounded memo of two generations: when the young one is full it becomes the old one, so
    frequent keys stay."""

    def __init__(self, make, longest_key: int, max_entries: int):
        super().__init__()
        self.make, self.longest_key, self.half, self.old = make, longest_key, max_entries // 2, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest_key:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Classes(dict):
    """For ``str.translate``: a stand-in of the class (letter, number, white space, other) that the library's pre-tokenizer
    gives a non-ASCII character."""

    def __init__(self, pattern: str):
        super().__init__({i: i for i in range(128)})
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)

    def __missing__(self, point: int) -> int:
        c = chr(point)
        found = {x for x, _ in self.split.pre_tokenize_str(f"a{c}a !{c}!")}
        kind = "a" if f"a{c}a" in found else "\ue000" if f"!{c}!" in found else "1" if c in found else " "
        self[point] = ord(kind)
        return self[point]


class Unknown(dict):
    """For ``str.translate``: deletes the characters whose normal form this Python surely shares with the library. Marks stay, as
    tables of another age know fewer of them and so order them otherwise, and so do characters that Python doesn't know."""

    def __missing__(self, point: int) -> int | None:
        c = chr(point)
        self[point] = point if unicodedata.combining(c) or unicodedata.category(c) == "Cn" else None
        return self[point]


@lru_cache(maxsize=1)
def composed_seconds() -> frozenset[str]:
    """Characters that normalisation may join to the one before them, besides those with a combining class."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def stands_alone(c: str) -> bool:
    """Whether a text can be cut before ``c`` without a change of its normal form."""
    return c.isascii() or not (unicodedata.combining(c) or c in composed_seconds() or unicodedata.category(c) == "Cn")


class Encoder:
    """From raw text to ids, by white-space-separated words; short words are remembered."""

    def __init__(self, path: str, max_entries: int = 160_000):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.table = MergeTable(model["vocab"], map(tuple, model["merges"]), self.suffix)
        self.names = {i: s for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: s for s, i in self.special.items()}
        self.symbols = byte_symbols()
        self.inner = [model["vocab"][s] for s in self.symbols]
        self.last = [model["vocab"][s + self.suffix] for s in self.symbols]
        self.sizes = {i: len(s.removesuffix(self.suffix)) for s, i in model["vocab"].items()}
        rule = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(rule)
        self.runs = {True: regex.compile(r"\p{L}+"), False: regex.compile(r"[^\s\p{L}\p{N}]+")}
        self.classes, self.unknown = Classes(rule), Unknown()
        self.normaliser = Tokenizer.from_file(path).normalizer
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.blank, self.last_blank = regex.compile(r"\p{White_Space}+"), regex.compile(r"(?r)\p{White_Space}")
        self.transducer = Transducer(self.table, self.sizes)
        self.words = Memo(self._word, 40, max_entries)
        self.pieces = Memo(self._piece, 40, max_entries)

    def _piece(self, piece: str) -> bytes:
        """Ids (as 32-bit words) of one pre-token, through the transducer."""
        raw = piece.encode("utf-8")
        inner, machine = self.inner, self.transducer
        symbols = [inner[x] for x in raw]
        symbols[-1] = self.last[raw[-1]]
        return array("i", machine.push(symbols) + machine.flush()).tobytes()

    def _plain(self, part: str) -> str:
        """The normal form in lower case."""
        if part.isascii():
            return part.lower()
        if part.translate(self.unknown):
            return self.normaliser.normalize_str(part)
        # one code point at a time: the final-sigma rule of str.lower does not apply
        return unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()

    def _word(self, word: str) -> bytes:
        if word.isascii() and "<|" not in word:
            plain = word.lower()
            if plain.isalpha():
                return self.pieces[plain]
            if plain[:-1].isalpha() and plain[-1] in ".,;:!?":
                return self.pieces[plain[:-1]] + self.pieces[plain[-1]]
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(plain)))
        out = []
        for k, part in enumerate(self.cut.split(word)):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
                continue
            plain = self._plain(part)
            out.extend(self.pieces[plain[m.start() : m.end()]] for m in self.pattern.finditer(plain.translate(self.classes)))
        return b"".join(out)

    def _words(self, text: str) -> bytes:
        # str.split also parts at U+001C..U+001F, which are no white space to the tokenizer
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        words = [w for w in self.blank.split(text) if w] if odd else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def stream(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """Ids of a text that comes in pieces, as they settle."""
        rest, more = "", iter(pieces)
        for piece in more:
            rest += piece
            end = self.last_blank.search(rest)
            if end:
                yield self._words(rest[: end.start()])
                rest = rest[end.start() :]
            if len(rest) > BLOCK:
                rest = yield from self._long(rest, more)
        yield self._words(rest)

    def _long(self, raw: str, more: Iterator[str]) -> Iterator[bytes]:
        """Ids of the word that ``raw`` begins with, as far as ``more`` goes on with it; returns the text after it."""
        run, ended = LongWord(self), False
        raw = raw.lstrip() if self.blank.match(raw) else raw
        while True:
            blank = self.blank.search(raw)
            word, after = (raw[: blank.start()], raw[blank.start() :]) if blank else (raw, "")
            if special := self.cut.search(word):
                yield run.feed(self._plain(word[: special.start()]), True)
                yield array("i", [self.special[special[0]]]).tobytes()
                raw = raw[special.end() :]
                continue
            if blank or ended:
                yield run.feed(self._plain(word), True)
                return after
            at = len(raw) - MARGIN
            while at > 0 and not stands_alone(raw[at]):
                at -= 1
            if at > 0:
                yield run.feed(self._plain(raw[:at]), False)
                raw = raw[at:]
            piece = next(more, None)
            raw, ended = raw + (piece or ""), piece is None

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(pieces_of(text))), np.int32)


def pieces_of(text: str | None) -> Iterator[str]:
    text = text or ""
    return (text[i : i + BLOCK] for i in range(0, len(text), BLOCK))


class LongWord:
    """Pre-tokens of a word that comes in pieces; one that reaches a piece's end goes to a transducer bit by bit."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.machine = encoder, Transducer(encoder.table, encoder.sizes)
        self.rest, self.run, self.held = "", None, 0

    def feed(self, plain: str, ends: bool) -> bytes:
        e, plain = self.encoder, self.rest + plain
        shown, at, out = plain.translate(e.classes), 0, []
        while at < len(shown):
            if self.run:
                found = self.run.match(shown, at)
                if found:
                    out.append(self._symbols(plain[at : found.end()]))
                    at = found.end()
                if at == len(shown) and not ends:
                    break
                out.append(self._close())
                continue
            found = e.pattern.match(shown, at)
            if not ends and len(shown) - found.end() < MARGIN:  # it may go on, or be cut
                if found.end() - at <= MARGIN:
                    break
                self.run = e.runs[shown[at].isalpha()]
                self.held = None
                continue
            out.append(e.pieces[plain[at : found.end()]])
            at = found.end()
        self.rest = plain[at:]
        if ends and self.run:
            out.append(self._close())
        return b"".join(out)

    def _symbols(self, text: str) -> bytes:
        """All symbols but the last, which may be the end of the pre-token."""
        raw = text.encode("utf-8")
        raw = raw if self.held is None else bytes([self.held]) + raw
        self.held = raw[-1]
        return array("i", self.machine.push([self.encoder.inner[x] for x in raw[:-1]])).tobytes()

    def _close(self) -> bytes:
        self.run = None
        return array("i", self.machine.push([self.encoder.last[self.held]]) + self.machine.flush()).tobytes()


class Decoder:
    """Ids in, text out, a block at a time, by way of bytes and an incremental UTF-8 machine that holds back unfinished
    sequences.

    ``library``: the tokenizer has no decoder part, so its text is the token strings parted by one
    space; whether a token was written is part of the state. ``text``: stand-ins become bytes, the end-of-word
    mark becomes a space.
    """

    def __init__(self, names: dict[int, str], suffix: str, style: str = "library"):
        self.style, self.begun = style, False
        self.byte = {s: b for b, s in enumerate(byte_symbols())}
        self.suffix = suffix
        turn = str.encode if style == "library" else self._bytes
        self.names = [turn(names.get(i, "")) for i in range(max(names) + 1)]
        self.between = b" " if style == "library" else b""
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def _bytes(self, name: str) -> bytes:
        body = name.removesuffix(self.suffix)
        if any(c not in self.byte for c in body):
            return name.encode()
        return bytes(self.byte[c] for c in body) + b" " * (body != name)

    def feed(self, ids: Iterable[int]) -> str:
        raw = self.between.join(map(self.names.__getitem__, ids))
        if raw and self.begun:
            raw = self.between + raw
        self.begun |= bool(raw)
        return self.utf8.decode(raw)

    def finish(self) -> str:
        self.begun = False
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", style: str = "library", place_col: str | None = None
) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded), and place if ``place_col`` is given, one for each row of ``docs``; no shuffle."""
    ensure_workers(docs.sparkSession, 64)  # texts, ids and decoded texts of a batch are in memory together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path)
        back = Decoder(machine.names, machine.suffix, style)
        for b in batches:
            ids, texts = [], []
            for t in b.column(1):
                parts, said = [], []
                for settled in machine.stream(pieces_of(t.as_py())):
                    parts.append(settled)
                    said.append(back.feed(memoryview(settled).cast("i")))
                ids.append(np.frombuffer(b"".join(parts), np.int32))
                texts.append("".join([*said, back.finish()]))
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                    pa.array(texts, pa.string()),
                    *b.columns[2:],
                ],
                ["doc_id", "n_tokens", "ids", "decoded", *["place"] * (b.num_columns - 2)],
            )

    place = [F.col(place_col).cast("long").alias("place")] if place_col else []
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), *place)
    return rows.mapInArrow(run, SCHEMA + ", place long" * len(place))
