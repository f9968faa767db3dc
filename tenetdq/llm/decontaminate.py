"""Benchmark decontamination by template canonicalisation.

Texts become templates: tokens are lower-cased words without outer punctuation; numbers, names (runs of
capitalised words) and units (after a number) are replaced by typed placeholders. A capitalised word that begins a
sentence may or may not be a name, so each text has two readings: it is literal in the one and a name in the other.
Windows of ``WINDOW`` template tokens with at least ``LITERALS`` literal ones are joined by hash with those of the
benchmark; each match brings the values that fill its slots. Matches of one item that follow each other in item and text
form an alignment; from one match to the next at most ``WINDOW`` words may be inserted or left out. It counts when

* it covers at least ``COVERAGE`` of the item's windows, or ``RUN`` windows match; windows between two matches that
  leave at most one word of the item between them are covered too, for they are lost by the edit of that word; and
* its slots are consistent: one benchmark value always stands for the same value in the text, so a
  question with other numbers, names or units is caught and a mere patchwork of templates is not.

A pre-filter of fixed size (``FILTER_BITS``, whatever the benchmark's size) keeps windows that
occur in no item from being shuffled; the exact join follows. Consistency depends on which of an item's slots are
equal, so items with equal templates and equal slots at equal places are matched once and listed together.

Defined cases: null, empty or wordless texts match nothing; an item shorter than a window is one window and looked up at its
length; an item without a window of enough literals is matched by its raw words; one of fewer than ``LITERALS`` words
only by texts that consist of it; repeated rows are each judged by their text. Words on the outer
side of an edit count only where they fill a window, so an edit near an item's end, or the middle word of one of 15, can hide it.
"""
from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenetdq.functions.lookup import attach
from tenetdq.llm.common import bounded_batches, own_cache, settled, wrapped

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
RUN = 20
FILTER_BITS = 1 << 22
BASE = 0x9E3779B97F4A7C15      # of the windows' polynomials; odd
WORD_CACHE = 200_000
CLOSING, ENDS = "\"')]”’»", frozenset(".!?:…|")
LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)
END = 8                        # added to a kind
PLAIN, STARTS, RAW = range(3)  # readings: sentence starts are literal, or names; all words are literal
MARKS = [0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333, 0]
# Unit words that may follow a number.
UNITS = set("""mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms
ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes
hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree
degrees meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters kb mb gb tb
hz khz mhz ghz watt watts volt volts joule joules mph kmh""".split())
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”‘’«»¿¡–—"


class _Words(dict):
    """Raw word -> place in growing arrays of literal hash, and of kind (plus ``END`` where a sentence ends there)."""

    def __init__(self):
        super().__init__()
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.hash, self.code = array("Q"), array("b")

    def __missing__(self, raw: str) -> int:
        core, code = raw, LITERAL
        if not raw.isalpha():
            core = raw.strip(OUTER)
            if not core:
                code = NOTHING + END
            elif raw.rstrip(CLOSING)[-1:] in ENDS:
                code = END
        low = core.lower()
        if core.isalpha():
            if core[0].isupper() and core[1:].islower():
                code += NAME
            elif low in UNITS:
                code += UNIT
        elif any(map(str.isdigit, core)):
            code += NUMBER
        place = self[raw] = len(self)
        self.hash.append(xxhash.xxh3_64_intdigest(low) | 1)
        self.code.append(code)
        return place


def words_of(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text, the literal hash and kind of each, and whether it begins a sentence."""
    known = own_cache("decontaminate", _Words)
    if len(known) > WORD_CACHE:
        known.restart()
    raw = (text or "").split()
    if not raw:
        return [], np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool)
    at = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
    hashes, codes = np.frombuffer(known.hash, np.uint64)[at], np.frombuffer(known.code, np.int8)[at]
    kinds, starts = codes & (END - 1), _after(codes >= END, True)   # what stood before ends a sentence
    if not (kinds == NOTHING).any():
        return raw, hashes, kinds, starts
    used = np.flatnonzero(kinds != NOTHING)
    return [raw[i] for i in used.tolist()], hashes[used], kinds[used], starts[used]


def _after(flags: np.ndarray, first: bool) -> np.ndarray:
    """Of each place what holds for the one before it."""
    out = np.empty(len(flags), bool)
    out[:1], out[1:] = first, flags[:-1]
    return out


def template(hashes: np.ndarray, kinds: np.ndarray, starts: np.ndarray, reading: int) -> tuple[np.ndarray, ...]:
    """Template tokens as hashes, their kinds (0 for literals), and the word where each begins, with the end."""
    if reading == RAW or not len(kinds):
        return hashes, np.zeros_like(kinds), np.arange(len(kinds) + 1)
    kinds = kinds.copy()
    if reading == PLAIN:
        kinds[(kinds == NAME) & starts] = LITERAL
    after_number = _after(kinds == NUMBER, False)
    kinds[(kinds == UNIT) & ~after_number] = LITERAL
    name = kinds == NAME
    at = np.flatnonzero(~(name & _after(name, False) & ~starts))        # a run of names is one token
    kinds = kinds[at]
    return np.where(kinds == LITERAL, hashes[at], np.array(MARKS, np.uint64)[kinds]), kinds, np.append(at, len(name))


def window_hashes(tokens: np.ndarray, kinds: np.ndarray, reading: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each window of ``size`` tokens that has enough literals (any, in raw words)."""
    n = len(tokens) - size + 1
    if n < 1 or not size or (size < LITERALS and n > 1):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, done, power, width = np.full(n, np.uint64(size + 256 * reading)), 0, tokens, 1
    while width <= size:                                     # power: polynomial of the next width tokens, by doubling
        factor = np.uint64(pow(BASE, width, 1 << 64))
        if size & width:
            h, done = h * factor + power[done:done + n], done + width
        if 2 * width <= size:
            power = power[:-width] * factor + power[width:]
        width *= 2
    h ^= h >> np.uint64(31)
    literal = np.zeros(len(kinds) + 1, np.int32)
    np.cumsum(kinds == LITERAL, out=literal[1:])
    starts = np.flatnonzero(literal[size:] - literal[:n] >= (0 if reading == RAW else LITERALS))
    return starts, h[starts].astype(np.int64)


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> 11) & (FILTER_BITS - 1)


def _slots(words: list[str], kinds: np.ndarray, at: np.ndarray, start: int, end: int) -> list[str]:
    """Values of the placeholders among the tokens from ``start`` to ``end``."""
    return [" ".join(w.strip(OUTER).lower() for w in words[at[i]:at[i + 1]])
            for i in (start + np.flatnonzero(kinds[start:end] != LITERAL)).tolist()]


ITEM_WINDOWS = pa.schema([
    ("item_id", pa.int64()), ("head", pa.string()), ("hash", pa.int64()), ("pos", pa.int32()), ("rank", pa.int32()),
    ("base", pa.int32()), ("classes", pa.list_(pa.int32())), ("size", pa.int32()), ("n_windows", pa.int32()),
    ("n_tokens", pa.int32()), ("n_slots", pa.int32()), ("reading", pa.int32()), ("values", pa.list_(pa.string()))])
ITEM_SCHEMA = ("item_id long, head string, hash long, pos int, rank int, base int, classes array<int>, size int, n_windows int, "
               "n_tokens int, n_slots int, reading int, values array<string>")
FOUND = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_bytes", pa.int64()), ("ref", pa.int64()), ("head", pa.string()),
    ("matched", pa.int32()), ("n_windows", pa.int32()), ("first", pa.int32()), ("last", pa.int32()),
    ("values", pa.list_(pa.string()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of both readings of each item, or of its raw words; the first one of a reading has all slot values."""
    for b in batches:
        rows = []
        for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            words, *parts = words_of(text)
            before = len(rows)
            for reading in (PLAIN, STARTS, RAW):
                if reading == RAW and len(rows) > before:
                    continue
                tokens, kinds, at = template(*parts, reading)
                size = min(WINDOW, len(tokens))
                starts, hashes = window_hashes(tokens, kinds, reading, size)
                values = _slots(words, kinds, at, 0, len(tokens))
                first: dict[str, int] = {}
                classes = [first.setdefault(v, k) for k, v in enumerate(values)]
                head = xxhash.xxh3_128_hexdigest(bytes([reading]) + tokens.tobytes() + np.array(classes, np.int32).tobytes())
                base = np.append(0, np.cumsum(kinds != LITERAL)).tolist()
                rows += [(item, head, h, s, rank, base[s], classes[base[s]:base[s + size]], size, len(starts), len(tokens),
                          len(values), reading, None if rank else values)
                         for rank, (s, h) in enumerate(zip(starts.tolist(), hashes.tolist(), strict=True))]
        yield _batch(rows, ITEM_WINDOWS)


def _text_windows(bits: bytes, shapes: list[tuple[int, int]]):
    """Windows of the readings and sizes that occur among the items, where the filter knows their hash."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        part, seen = TaskContext.get().partitionId() << 40, 0
        for b in batches:
            rows = []
            for i, text in enumerate(b.column("text").to_pylist()):
                words, *parts = words_of(text)
                made = {reading: template(*parts, reading) for reading, _ in shapes}
                for reading, size in shapes:
                    tokens, kinds, at = made[reading]
                    starts, hashes = window_hashes(tokens, kinds, reading, size)
                    for k in np.flatnonzero(known[_bit(hashes)]).tolist():
                        s = int(starts[k])
                        rows.append((i, part + seen + i, int(hashes[k]), s, _slots(words, kinds, at, s, s + size),
                                     int(at[s]), int(at[s + size]) - 1))
            seen += b.num_rows
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            row = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(row), b.column("text_hash").take(row), b.column("text_bytes").take(row),
                 pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()),
                 pa.array(cols[4], pa.list_(pa.string())), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int32())],
                ["doc_id", "text_hash", "text_bytes", "ref", "hash", "doc_pos", "doc_slots", "first", "last"])

    return find


class _Alignments:
    """Alignments of one item in one text from its matches in text order.

    Each diagonal (place in the text less place in the item) has a chain of its own matches and the best chain that ends
    on it and may come from near diagonals. A chain's node: previous node, match, number of matches, windows covered."""

    def __init__(self, n_windows: int, n_tokens: int, n_slots: int):
        self.n_windows, self.n_slots, self.reach = n_windows, n_slots, n_tokens + 2 * WINDOW
        self.own, self.any, self.best, self.edge = {}, {}, None, 0

    def add(self, m: tuple) -> None:
        doc_pos, pos = m[:2]
        if doc_pos >= self.edge:
            self.close(doc_pos - self.reach)
            self.edge = doc_pos + self.reach
        diagonal = doc_pos - pos
        self.own[diagonal] = self._after(self.own.get(diagonal), m)
        near = [self.any.get(diagonal + k) for k in (0, *(s * j for j in range(1, WINDOW + 1) for s in (1, -1)))]
        near = [self._after(c, m) for c in near if c and c[1][1] < pos and c[1][0] < doc_pos]
        self.any[diagonal] = max(near, key=lambda c: c[3]) if near else self._after(None, m)

    @staticmethod
    def _after(chain: tuple | None, m: tuple) -> tuple:
        if chain is None:
            return None, m, 1, 1
        last = chain[1]
        bridged = m[1] - last[1] <= m[3] + 1                   # at most one word of the item lies between
        return chain, m, chain[2] + 1, chain[3] + (m[2] - last[2] if bridged else 1)

    def close(self, before: int) -> None:
        """Judge and forget the chains that ended before a place of the text."""
        for chains in (self.own, self.any):
            for d in [d for d, c in chains.items() if c[1][0] < before]:
                self._judge(chains.pop(d))

    def _judge(self, chain: tuple) -> None:
        _, _, matched, covered = chain
        if covered < COVERAGE * self.n_windows and matched < RUN:
            return
        said, values, first, last = {}, [""] * self.n_slots, None, chain[1][8]
        while chain:
            chain, (_, _, _, _, base, classes, slots, first, end), _, _ = chain
            last = max(last, end)
            for k, (c, v) in enumerate(zip(classes, slots, strict=True), base):
                if said.setdefault(c, v) != v or values[k] not in ("", v):
                    return
                values[k] = v
        self.best = max(self.best or (0,), (matched, self.n_windows, first, last, values))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best alignment that counts of each text and item; rows come sorted by text, item and place in the text."""
    key, state = None, None

    def done() -> list[tuple]:
        if state is None:
            return []
        state.close(1 << 62)
        return [(*key, *state.best)] if state.best else []

    for b in batches:
        rows = []
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[:5] != key:
                rows += done()
                key, state = r[:5], _Alignments(*r[14:17])
            state.add(r[5:14])
        yield _batch(rows, FOUND)
    yield _batch(done(), FOUND)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Alignments that count: doc_id, item_ids, matched, n_windows, first and last word place,
    reparameterised, and text_hash and text_bytes, which name the text whatever its id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = settled(benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _item_windows, ITEM_SCHEMA), "item-windows")
    heads = items.drop("item_id", "values", "reading").dropDuplicates(["head", "pos"])
    named = items.where("rank = 0").select("head", "item_id", "values")
    shapes = [(r["reading"], r["size"]) for r in items.select("reading", "size").distinct().collect()]  # 3 x WINDOW at most
    place = F.shiftright(F.col("hash"), 11).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = items.select(F.shiftright(place, 3).cast("int").alias("at"), (place % 8).cast("int").alias("bit")).groupBy(
        "at").agg(F.bit_or(F.expr("shiftright(128, bit)")).alias("byte")).collect()  # FILTER_BITS / 8 rows at most
    bits = bytearray(FILTER_BITS // 8)
    for r in words:
        bits[r["at"]] = r["byte"]

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.select("doc_id", "text", F.xxhash64("text").alias("text_hash"),
                     F.octet_length("text").cast("long").alias("text_bytes"))
    found = src.mapInArrow(_text_windows(bytes(bits), sorted(shapes)), "doc_id long, text_hash long, text_bytes long, ref long, "
                           "hash long, doc_pos int, doc_slots array<string>, first int, last int")
    joined = settled(found, "text-windows").join(heads, "hash").where(F.size("classes") == F.size("doc_slots"))
    best = settled(joined.select(
        "doc_id", "text_hash", "text_bytes", "ref", "head", "doc_pos", "pos", "rank", "size", "base", "classes", "doc_slots",
        "first", "last", "n_windows", "n_tokens", "n_slots").repartition("ref", "head").sortWithinPartitions(
        "ref", "head", "doc_pos", "pos").mapInArrow(
        _align, "doc_id long, text_hash long, text_bytes long, ref long, head string, matched int, n_windows int, "
                "first int, last int, values array<string>"), "alignments")
    # Verbatim: the text's values are those of some item of the head, in all slots that were seen.
    best = best.withColumn("seen", F.transform("values", lambda v: v != ""))
    verbatim = named.join(best.select("head", "seen").distinct(), "head").select(
        "head", "seen", F.zip_with("values", "seen", lambda v, s: F.when(s, v).otherwise("")).alias("values"),
        F.lit(False).alias("changed")).distinct()
    best = best.join(verbatim, ["head", "seen", "values"], "left").withColumn("changed", F.coalesce("changed", F.lit(True)))
    # An item's readings may both be found: the better one stands.
    key = ["doc_id", "text_hash", "text_bytes", "ref"]
    each = best.join(named.select("head", "item_id").distinct(), "head").groupBy(*key, "item_id").agg(
        F.max(F.struct("matched", "n_windows", "first", "last", (~F.col("changed")).alias("same"))).alias("m"))
    return each.groupBy(*key, "m").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select(
        "doc_id", "item_ids", "m.matched", "m.n_windows", F.col("m.first").alias("first_token"),
        F.col("m.last").alias("last_token"), (~F.col("m.same")).alias("reparameterised"), "text_hash", "text_bytes")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, in its columns."""
    leaks = settled(matches(docs, benchmark).select("text_hash", "text_bytes").distinct(), "leaks")
    text = F.col("row.text").cast("string")
    rows = wrapped(docs).withColumns({"text_hash": F.xxhash64(text), "text_bytes": F.octet_length(text).cast("long")})
    # broadcast where the leaks are measured few
    kept = attach(rows, leaks, ["text_hash", "text_bytes"], how="left_anti")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
