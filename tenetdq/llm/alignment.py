"""Cross-tokenizer alignment with an associative monoid of fragments.

Two tokenizers A and B cut the bytes of space + text. Offsets where tokens of both end cut them into *groups*; an A and a B
token whose byte ranges overlap are *linked*.

*Fragments.* What is known of a byte range, from the tokens that end in it, is an open prefix (the tokens up to the first common
end), closed groups, and an open suffix (the tokens after the last common end). ``compose`` joins the fragments of neighbouring
ranges: the suffix of the one and the prefix of the other close a group. It is associative, so ranges are aligned in any
tasks and composed in a tree.

*Short texts* are one range. They are cut at spaces that neither tokenizer joins with what stands before; what lies
between two such spaces is a fragment with nothing open, is aligned once per worker, and is kept in a bounded cache.
*Long texts* are cut into ranges of ``RANGE`` bytes wherever that falls, inside a word, a token or a character. A range travels
with the bytes to the next safe spaces on both sides, so its tokens are those of the whole text; ranges of one text are aligned in
different tasks, and ``FAN`` fragments at a time are composed until one is left. A stretch without a safe
space is never cut, since only the tokenizers' own look at the whole of it gives its tokens.

*Counts.* Texts are tokenized once; each row keeps its digest, its numbers and its id pairs with their links, in a table that is
summed to the corpus counts. The pairs are measured: up to ``MOST_PAIRS`` they go to the workers as sorted arrays
that a second pass over the table looks up; beyond, the pairs of the rows are joined to the counts by a shuffle.

Defined cases: null and empty texts, and texts whose tokens of A or B don't spell space + text, have no tokens, zeros and an
empty digest; strings of special tokens are plain text; repeated rows are each counted and returned; ties for the highest count of
a B id are all best; columns other than the identifier and the text are ignored, whatever their names; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import os
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenetdq.llm.common import bounded_batches, settled
from tenetdq.llm.tokens import PRE_TOKENS, PUNCTUATION, _Letters

RANGE = 48 << 10               # bytes of a range of a long text
FAN = 8                        # fragments composed by one task
CACHE_PIECES = 400_000
CACHE_CHARS = 32 << 20
MOST_PAIRS = 6_000_000         # id pairs that are sent to the workers: 102 MB
FLUSH_PAIRS = 4_000_000
LOW = (1 << 32) - 1
# bytes that surely begin a character that is no white space
SOLID = frozenset([*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)])


class Part(NamedTuple):
    """Tokens of both kinds with the byte offsets where they end."""
    a: list[int] = []
    a_ends: list[int] = []
    b: list[int] = []
    b_ends: list[int] = []

    def plus(self, other: Part) -> Part:
        return Part(*[x + y for x, y in zip(self, other, strict=True)])

    def between(self, low: int, high: int) -> Part:
        """The tokens that end in (low, high]."""
        a = [i for i, e in enumerate(self.a_ends) if low < e <= high]
        b = [i for i, e in enumerate(self.b_ends) if low < e <= high]
        return Part([self.a[i] for i in a], [self.a_ends[i] for i in a], [self.b[i] for i in b], [self.b_ends[i] for i in b])


class Closed(NamedTuple):
    """Complete groups: their text, their tokens of A and of B, their number, and their links by pair (A id << 32 | B id)."""
    text: str
    n_a: int
    n_b: int
    n_groups: int
    links: Counter

    def plus(self, other: Closed) -> Closed:
        if not self.n_groups or not other.n_groups:
            return other if not self.n_groups else self
        return Closed(f"{self.text};{other.text}", self.n_a + other.n_a, self.n_b + other.n_b,
                      self.n_groups + other.n_groups, self.links + other.links)


NOTHING = Closed("", 0, 0, 0, Counter())


class Fragment(NamedTuple):
    head: Part
    closed: Closed | None      # None: no common end, everything is in head
    tail: Part


def groups_of(part: Part) -> tuple[list[str], list[int]]:
    """The groups of tokens that begin and end together, and the pairs linked, in order."""
    a, a_ends, b, b_ends = part
    groups, links, i, j, from_i, from_j = [], [], 0, 0, 0, 0
    while i < len(a):
        links.append(a[i] << 32 | b[j])
        if a_ends[i] == b_ends[j]:
            i, j = i + 1, j + 1
            groups.append(f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
            from_i, from_j = i, j
        elif a_ends[i] < b_ends[j]:
            i += 1
        else:
            j += 1
    return groups, links


def close(part: Part) -> Closed:
    groups, links = groups_of(part)
    return Closed(";".join(groups), len(part.a), len(part.b), len(groups), Counter(links))


def fragment(part: Part) -> Fragment:
    """The fragment of a byte range from the tokens that end in it."""
    common = set(part.a_ends).intersection(part.b_ends)
    if not common:
        return Fragment(part, None, Part())
    first, last = min(common), max(common)
    return Fragment(part.between(-1, first), close(part.between(first, last)), part.between(last, 1 << 62))


def compose(left: Fragment, right: Fragment) -> Fragment:
    if left.closed is None:
        return Fragment(left.head.plus(right.head), right.closed, right.tail)
    if right.closed is None:
        return Fragment(left.head, left.closed, left.tail.plus(right.head))
    return Fragment(left.head, left.closed.plus(close(left.tail.plus(right.head))).plus(right.closed), right.tail)


def whole(f: Fragment) -> Closed:
    """All groups of a text: its start and end are common ends."""
    return close(f.head) if f.closed is None else close(f.head).plus(f.closed).plus(close(f.tail))


class Tokenizers:
    """Tokens of A (byte-level BPE) and B (sentence pieces) with their bytes."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        a = Tokenizer.from_file(a_path)
        self._merge, self._letters, self._ends = a.model.tokenize, _Letters(), {}
        byte = {c: b for b, c in self._letters._byte.items()}
        self.a_bytes = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(byte[c] for c in token)
        self._b = SentencePieceProcessor(model_file=b_path)
        size = self._b.get_piece_size()
        pieces = [self._b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B spans a space: texts can't be cut there")
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.a_name, self.b_name = [str(i) for i in range(len(self.a_size))], [str(i) for i in range(len(self.b_size))]

    def a_ids(self, piece: str) -> list[int]:
        """Tokens of A of space + piece."""
        word = piece.rstrip(PUNCTUATION)
        if word.isalpha():                                   # one pre-token, perhaps with an end
            shown = word if word.isascii() else "".join(map(self._letters.__getitem__, word))
            found = [t.id for t in self._merge("Ġ" + shown)]
            return found + self._end(piece[len(word):]) if len(word) < len(piece) else found
        return [t.id for pre in PRE_TOKENS.findall(" " + piece) for t in self._merge("".join(map(self._letters.__getitem__, pre)))]

    def _end(self, end: str) -> list[int]:
        found = self._ends.get(end)
        if found is None:
            if len(self._ends) > 20_000:
                self._ends.clear()
            found = self._ends[end] = [t.id for t in self._merge("".join(map(self._letters.__getitem__, end)))]
        return found

    def ids(self, pieces: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Tokens of space + each piece; None where those of A or B don't spell it."""
        a_size, b_bytes = self.a_size, self.b_bytes
        for piece, b in zip(pieces, self._b.encode(pieces, num_threads=1), strict=True):
            a, raw = self.a_ids(piece), f" {piece}".encode()
            # tokens of A are consecutive bytes by construction, so their length tells
            spelled = sum([a_size[i] for i in a]) == len(raw) and b"".join([b_bytes[i] for i in b]) == raw
            yield (a, b) if spelled else None

    def part(self, piece: str, start: int) -> Part | None:
        """The tokens of space + piece with their ends, when it begins at byte ``start``."""
        found = next(self.ids([piece]))
        if found is None:
            return None
        a, b = found
        return Part(a, [start + e for e in accumulate(self.a_size[i] for i in a)],
                    b, [start + e for e in accumulate(self.b_size[i] for i in b)])

    def aligned(self, a: list[int], b: list[int]) -> tuple[list[str], list[int]]:
        """:func:`groups_of` for tokens that begin and end together, by their lengths."""
        a_size, b_size, a_name, b_name = self.a_size, self.b_size, self.a_name, self.b_name
        groups, links, i, j, last = [], [], 0, 0, len(a) - 1
        x, y = a[0], b[0]
        a_end, b_end, said_a, said_b = a_size[x], b_size[y], a_name[x], b_name[y]
        while True:
            links.append(x << 32 | y)
            if a_end == b_end:
                groups.append(f"{said_a}|{said_b}")
                if i == last:
                    return groups, links
                i, j = i + 1, j + 1
                x, y = a[i], b[j]
                a_end, b_end, said_a, said_b = a_end + a_size[x], b_end + b_size[y], a_name[x], b_name[y]
            elif a_end < b_end:
                i += 1
                x = a[i]
                a_end, said_a = a_end + a_size[x], f"{said_a},{a_name[x]}"
            else:
                j += 1
                y = b[j]
                b_end, said_b = b_end + b_size[y], f"{said_b},{b_name[y]}"


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair of tokenizers per Python worker."""
    return Tokenizers(a_path, b_path)


class Pieces:
    """What a worker knows of the pieces it met: their groups, their numbers (A, B, groups, links) and their links."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        self.wrong: set[int] = set()                        # pieces that their tokens don't spell
        self.numbers, self.links, self.first = array("q"), array("q"), array("q")
        self.hits = np.zeros(1 << 16, np.int64)

    def renew(self) -> None:
        """Forget what was met once; if that is not enough, all but the most frequent half."""
        n, most = len(self.groups), CACHE_PIECES // 2
        keep = np.flatnonzero(self.hits[:n] > 1)
        if len(keep) > most:
            keep = np.sort(np.argpartition(-self.hits[:n], most)[:most])
        old, keys = (self.groups, self.wrong, np.array(self.numbers).reshape(-1, 4), np.array(self.first), np.array(self.links)), list(self.at)
        self.clear()
        groups, wrong, numbers, first, links = old
        for i in keep.tolist():
            at = self.at[keys[i]] = len(self.groups)
            self.groups.append(groups[i])
            self.chars += len(keys[i])
            if i in wrong:
                self.wrong.add(at)
        if self.chars > CACHE_CHARS // 2:
            self.clear()
            return
        n = numbers[keep, 3]
        ends = np.cumsum(n)
        self.numbers = array("q", numbers[keep].tobytes())
        self.first = array("q", (ends - n).tobytes())
        self.links = array("q", links[np.arange(n.sum()) + np.repeat(first[keep] - ends + n, n)].tobytes())

    @property
    def full(self) -> bool:
        return len(self.groups) > CACHE_PIECES or self.chars > CACHE_CHARS

    def _learn(self, keys: list[str]) -> None:
        both, groups, first, at, all_links, numbers = self.both, self.groups, self.first, self.at, self.links, self.numbers
        aligned, n_links = both.aligned, len(all_links)
        self.chars += sum(map(len, keys))
        for key, ids in zip(keys, both.ids([k[1:] if k[0] == " " else k for k in keys]), strict=True):
            at[key] = len(groups)
            first.append(n_links)
            if ids is None:
                self.wrong.add(len(groups))
                groups.append("")
                numbers.extend((0, 0, 0, 0))
                continue
            a, b = ids
            own, links = aligned(a, b)
            groups.append(";".join(own))
            numbers.extend((len(a), len(b), len(own), len(links)))
            all_links.extend(links)
            n_links += len(links)

    def places(self, keys: list[str], marked: bool = False) -> np.ndarray | None:
        """The pieces of a text split at spaces; None if its tokens don't spell it."""
        found = list(map(self.at.get, keys))
        if None in found:
            new = [k for k, i in zip(keys, found, strict=True) if i is None]
            if not marked and any(not k or k[0].isspace() for k in new):       # such pieces are only known marked
                keys = _marked(keys)
                new = [k for k in keys if k not in self.at]
            self._learn(list(dict.fromkeys(new)))
            found = list(map(self.at.__getitem__, keys))
        return None if self.wrong and not self.wrong.isdisjoint(found) else np.array(found, np.int64)

    def closed(self, places: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Groups, numbers, and pairs with their links of pieces that follow each other."""
        if len(self.groups) > len(self.hits):
            self.hits = np.concatenate([self.hits, np.zeros(len(self.groups), np.int64)])
        np.add.at(self.hits, places, 1)
        numbers = np.frombuffer(self.numbers, np.int64).reshape(-1, 4)[places]
        n = numbers[:, 3]
        first = np.frombuffer(self.first, np.int64)[places]
        links = np.frombuffer(self.links, np.int64)[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
        keys, times = np.unique(links, return_counts=True)
        return ";".join([self.groups[i] for i in places.tolist()]), numbers.sum(axis=0), keys, times


def _marked(parts: list[str]) -> list[str]:
    """Pieces of a text split at spaces, put together where a space can't be cut; such pieces are marked by a space before them."""
    out: list[str] = []
    for i, p in enumerate(parts):
        if i and parts[i - 1] and p and not p[0].isspace():
            out.append(p)
        elif i:
            out[-1] += " " + p
        else:
            out.append(p)
    return [p if p and " " not in p and not p[0].isspace() else " " + p for p in out]


@lru_cache(maxsize=1)
def known_pieces(a_path: str, b_path: str) -> Pieces:
    """One cache per Python worker."""
    return Pieces(tokenizers(a_path, b_path))


# -- long texts: ranges, fragments, tree -------------------------------------------------------------------------------------
def _safe(raw: bytes, at: int) -> bool:
    return at in (0, len(raw)) or (raw[at] == 32 and raw[at - 1] != 32 and at + 1 < len(raw) and raw[at + 1] in SOLID)


def ranges(raw: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, start, end): byte ranges and the safe places around each. A stretch without one ends its range."""
    low = 0
    while low < len(raw):
        start = low
        while not _safe(raw, start):
            start = max(0, raw.rfind(b" ", 0, start))
        high = min(low + size, len(raw))
        end = high
        while not _safe(raw, end):
            end = raw.find(b" ", end + 1)
            end = len(raw) if end < 0 else end
        if end - high > size:
            high = end
        yield low, high, start, end
        low = high


CHUNKS = "doc_id {}, ref long, part int, parts int, low long, high long, start long, raw binary"
PART = ["a", "a_ends", "b", "b_ends"]
FRAGMENTS = ("doc_id {}, ref long, part int, ok boolean, closed boolean, text string, n_a long, n_b long, n_groups long, "
             "keys array<long>, counts array<long>, " + ", ".join(f"{s}_{c} array<long>" for s in ("head", "tail") for c in PART))
WHOLE = "doc_id {}, ref long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, counts array<long>"


def _cut(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seen = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = b" " + text.encode()
                spans = list(ranges(raw, size))
                rows = [(base + seen, k, len(spans), low, high, start, raw[start:end])
                        for k, (low, high, start, end) in enumerate(spans)]
                seen += 1
                ids = pa.concat_arrays([b.column("doc_id").slice(i, 1)] * len(rows))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]],
                    ["doc_id", "ref", "part", "parts", "low", "high", "start", "raw"])

    return cut


def range_fragment(known: Pieces, raw: bytes, start: int, low: int, high: int) -> Fragment | None:
    """The fragment of the bytes (low, high] of a text, from a stretch of it between safe spaces that begins at ``start``."""
    keys = _marked(raw.decode()[1:].split(" "))
    sizes = [len(k.encode()) + (k[:1] != " ") for k in keys]     # a marked piece has its space in the key
    starts = [start, *[start + e for e in accumulate(sizes)]]
    inside = [i for i in range(len(keys)) if starts[i] >= low and starts[i + 1] <= high]
    out = Fragment(Part(), None, Part())
    for i in range(len(keys)):
        if inside and i == inside[0]:                           # whole pieces begin and end at common ends
            at = known.places([keys[k] for k in inside], marked=True)
            if at is None:
                return None
            text, n, pairs, times = known.closed(at)
            links = Counter(dict(zip(pairs.tolist(), times.tolist(), strict=True)))
            out = compose(out, Fragment(Part(), Closed(text, *n[:3].tolist(), links), Part()))
        elif not inside or i < inside[0] or i > inside[-1]:
            part = known.both.part(keys[i][1:] if keys[i][0] == " " else keys[i], starts[i])
            if part is None:
                return None
            out = compose(out, fragment(part.between(low, high)))
    return out


def _row(doc_id, ref: int, part: int, f: Fragment | None) -> dict:
    row = {"doc_id": doc_id, "ref": ref, "part": part, "ok": f is not None, "closed": f is not None and f.closed is not None}
    f = f or Fragment(Part(), None, Part())
    c = f.closed or NOTHING
    row |= {"text": c.text, "n_a": c.n_a, "n_b": c.n_b, "n_groups": c.n_groups, "keys": list(c.links), "counts": list(c.links.values())}
    for side, p in (("head", f.head), ("tail", f.tail)):
        row |= {f"{side}_{c}": x for c, x in zip(PART, p, strict=True)}
    return row


def _fragment_of(row: dict) -> Fragment | None:
    if not row["ok"]:
        return None
    closed = Closed(row["text"], row["n_a"], row["n_b"], row["n_groups"], Counter(dict(zip(row["keys"], row["counts"], strict=True))))
    sides = [Part(*[row[f"{s}_{c}"] for c in PART]) for s in ("head", "tail")]
    return Fragment(sides[0], closed if row["closed"] else None, sides[1])


def _schema(ddl: str, kind: pa.DataType) -> pa.Schema:
    named = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
             "array<long>": pa.list_(pa.int64()), "{}": kind}
    return pa.schema([(n, named[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])


def _fragments(a_path: str, b_path: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_pieces(a_path, b_path)
        for b in batches:
            schema = _schema(FRAGMENTS, b.schema.field("doc_id").type)
            for r in b.to_pylist():
                if known.full:
                    known.renew()
                f = range_fragment(known, r["raw"], r["start"], r["low"], r["high"])
                yield pa.RecordBatch.from_pylist([_row(r["doc_id"], r["ref"], r["part"], f)], schema)

    return make


def _composed(group: pa.Table) -> pa.Table:
    rows = sorted(group.drop_columns(["up"]).to_pylist(), key=lambda r: r["part"])
    parts = [_fragment_of(r) for r in rows]
    f = None if None in parts else reduce(compose, parts)
    first = rows[0]
    return pa.Table.from_pylist([_row(first["doc_id"], first["ref"], first["part"] // FAN, f)],
                                _schema(FRAGMENTS, group.schema.field("doc_id").type))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        schema = _schema(WHOLE, b.schema.field("doc_id").type)
        for r in b.to_pylist():
            f = _fragment_of(r)
            c = NOTHING if f is None else whole(f)
            row = {"doc_id": r["doc_id"], "ref": r["ref"], "n_a": c.n_a, "n_b": c.n_b, "n_groups": c.n_groups,
                   "n_links": sum(c.links.values()), "keys": list(c.links), "counts": list(c.links.values()),
                   "groups_sha256": hashlib.sha256(c.text.encode()).hexdigest() if c.n_groups else ""}
            yield pa.RecordBatch.from_pylist([row], schema)


def long_texts(rows: DataFrame, a_path: str, b_path: str, size: int = RANGE) -> DataFrame:
    """Alignment of each text (doc_id, text) by ranges: the columns of ``WHOLE``, settled."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    chunks = settled(rows.mapInArrow(_cut(size), CHUNKS.format(kind)), "align-ranges")
    level = chunks.agg(F.max("parts")).first()[0] or 0
    parts = settled(chunks.repartition("ref", "part").mapInArrow(_fragments(a_path, b_path), FRAGMENTS.format(kind)),
                    "align-fragments")
    while level > 1:
        level = -(-level // FAN)
        parts = settled(parts.withColumn("up", F.floor(F.col("part") / FAN).cast("int")).groupBy("ref", "up").applyInArrow(
            _composed, FRAGMENTS.format(kind)), "align-fragments")
    return settled(parts.mapInArrow(_finish, WHOLE.format(kind)), "align-long")


# -- short texts, counts and scores ------------------------------------------------------------------------------------------
def _short(a_path: str, b_path: str):
    """Short texts in the columns of ``WHOLE``."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, seen = known_pieces(a_path, b_path), (TaskContext.get().partitionId() << 40) + (1 << 39), 0
        none = np.empty(0, np.int64)
        for b in batches:
            n, digests, pairs, times = np.zeros((b.num_rows, 4), np.int64), [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                if known.full:
                    known.renew()
                at = known.places(text.split(" ")) if text else None
                said, n[i], keys, k = known.closed(at) if at is not None else ("", 0, none, none)
                digests.append(hashlib.sha256(said.encode()).hexdigest() if at is not None else "")
                pairs.append(keys)
                times.append(k)
            refs = np.arange(base + seen, base + seen + b.num_rows)
            seen += b.num_rows
            ends = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in pairs])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(refs), *[pa.array(np.ascontiguousarray(c)) for c in n.T], pa.array(digests, pa.string()),
                 *[pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *x]))) for x in (pairs, times)]],
                schema=_schema(WHOLE, b.schema.field("doc_id").type))

    return align


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair in a task, put together whenever ``FLUSH_PAIRS`` are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    for b in batches:
        held.append(tuple(b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("keys", "counts")))
        if sum(len(k) for k, _ in held) > FLUSH_PAIRS:
            held = [summed()]
            if len(held[0][0]) > FLUSH_PAIRS // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["key", "n"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["key", "n"])


SCORED = "doc_id {}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scores(shared):
    """Rows of ``WHOLE`` with the scores of their pairs, looked up in the corpus counts."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for b in batches:
            at = np.searchsorted(keys, b.column("keys").flatten().to_numpy())
            times = b.column("counts").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(b.column("keys").value_lengths().to_numpy())]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (best[at] * times, counts[at] * times)]
            n_best, count_sum = (pa.array((x[ends[1:]] - x[ends[:-1]]).astype(np.int64)) for x in sums)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], n_best, count_sum, b.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return score


def corpus_counts(pairs: DataFrame) -> DataFrame:
    """(key, n, best): links of each pair in the corpus, and whether that is the highest count of its B id."""
    counts = settled(pairs.groupBy("key").agg(F.sum("n").alias("n")), "align-pairs")
    b = F.col("key").bitwiseAND(F.lit(LOW))
    tops = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))        # at most one row per id of B's vocabulary
    return settled(counts.withColumn("b", b).join(F.broadcast(tops), "b").select(
        "key", "n", (F.col("n") == F.col("top")).alias("best")), "align-counts")


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Scores of settled rows of ``WHOLE`` by a shuffle of their pairs."""
    pairs = rows.select("ref", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select(
        "ref", F.col("x.keys").alias("key"), F.col("x.counts").alias("times"))
    scores = pairs.join(counts, "key").groupBy("ref").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(scores, "ref", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, a_path: str, b_path: str, size: int = RANGE, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    small = F.coalesce(F.octet_length("text"), F.lit(0)) <= size
    short = rows.where(small)
    long = long_texts(rows.where(~small), a_path, b_path, size)
    whole_rows = settled(short.mapInArrow(_short(a_path, b_path), WHOLE.format(kind)), "align-short").unionByName(long)
    counts = corpus_counts(whole_rows.select("keys", "counts").mapInArrow(_pair_sums, "key long, n long"))
    if counts.count() > most_pairs:
        return _joined(whole_rows, counts)
    told = counts.orderBy("key").toArrow()                                  # at most ``most_pairs`` rows
    arrays = [told.column(c).to_numpy() for c in ("key", "n", "best")]
    shared = spark.sparkContext.broadcast((arrays[0], arrays[1], arrays[2].astype(bool)))
    return whole_rows.mapInArrow(_scores(shared), SCORED.format(kind))
