"""Exact deduplication with Patricia-trie owners.

Equal means: identical after deleting every ASCII white-space character. The full byte strings
are inserted into compressed radix tries whose terminal nodes keep the owner of a text: the row
with the most code points, then the smallest identifier (a null identifier counts as
largest; rows equal in both are told apart by their place, so exactly one row stays).

1. *Local tries.* Each task folds windows of its rows: one record per distinct text and window,
   holding its owner so far, its count and its members. A text that makes up a third of all rows
   leaves a task as one record per window.
2. *Owner tries.* Records are dealt by (length, 64-bit content hash) and sorted by it, so the
   strings of one subtree arrive together. When the window is full, every subtree whose key has
   passed is spilled downstream and dropped; only the open key's owner is carried on. A task holds
   one window, whatever the partition's size, and writes nothing to local disks.

Defined cases: null text counts as empty, so null and blank texts form one group; the empty table
gives an empty result; repeated rows form one group with one kept row; other columns, of any name,
are carried unread.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenetdq.llm.common import WHITE, bounded_batches, own_cache, settled, windows, wrapped

WINDOW_BYTES = 24 << 20
WINDOW_ROWS = 100_000


class RadixTrie:
    """Compressed trie over byte strings; every distinct string gets one terminal number."""

    __slots__ = ("_root", "size")

    def __init__(self):
        self._root = [b"", {}, -1]                 # edge, children by first byte, terminal
        self.size = 0

    def insert(self, s: bytes) -> int:
        node, at, end = self._root, 0, len(s)
        while at < end:
            child = node[1].get(s[at])
            if child is None:
                leaf = [s[at:], {}, self.size]
                node[1][s[at]] = leaf
                self.size += 1
                return leaf[2]
            edge = child[0]
            if not s.startswith(edge, at):
                child = self._split(node, child, s, at)
                edge = child[0]
            node, at = child, at + len(edge)
        if node[2] < 0:
            node[2] = self.size
            self.size += 1
        return node[2]

    @staticmethod
    def _split(node: list, child: list, s: bytes, at: int) -> list:
        """Cut an edge where ``s`` leaves it and return the new inner node."""
        edge = child[0]
        low, high = 1, min(len(edge), len(s) - at)           # the common prefix, by halving
        while low < high:
            mid = (low + high + 1) // 2
            if s.startswith(edge[:mid], at):
                low = mid
            else:
                high = mid - 1
        inner = [edge[:low], {edge[low]: child}, -1]
        child[0] = edge[low:]
        node[1][inner[0][0]] = inner
        return inner


def _body(text: str | None) -> bytes:
    return (text or "").encode().translate(None, WHITE)


def _fold(records: pa.Table, bodies: list[bytes]) -> tuple[list[int], list[int], list[list[int]]]:
    """Terminals of a window: each one's owner row, summed count and rows."""
    trie = RadixTrie()
    points = records["points"].to_pylist()
    ids, refs = records["doc_id"].to_pylist(), records["ref"].to_pylist()
    counts = records["n"].to_pylist()
    owner, total, rows = [], [], []
    for i, body in enumerate(bodies):
        t = trie.insert(body)
        rank = (-points[i], ids[i] is None, ids[i] or 0, refs[i])
        if t == len(owner):
            owner.append((rank, i))
            total.append(counts[i])
            rows.append([i])
        else:
            owner[t] = min(owner[t], (rank, i))
            total[t] += counts[i]
            rows[t].append(i)
    return [i for _, i in owner], total, rows


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_cache("exact_dedup")                                 # nothing is kept; what others kept goes
    base, done = TaskContext.get().partitionId() << 40, 0
    for win in windows(batches, WINDOW_BYTES, WINDOW_ROWS):
        n = win.num_rows
        win = win.append_column("points", pc.fill_null(pc.utf8_length(win["text"]), 0).cast(pa.int64()))
        win = win.append_column("ref", pa.array(range(base + done, base + done + n), pa.int64()))
        win = win.append_column("n", pa.array([1] * n, pa.int64()))
        done += n
        bodies = [_body(t) for t in win["text"].to_pylist()]
        owners, total, rows = _fold(win, bodies)
        ids = win["doc_id"].to_pylist()
        members = [[{"doc_id": ids[i], "ref": base + done - n + i} for i in r] for r in rows]
        out = win.take(owners).drop_columns(["n"])
        own = [bodies[i] for i in owners]
        hashes = [xxhash.xxh3_64_intdigest(b) - (1 << 63) for b in own]
        out = (out.append_column("n", pa.array(total, pa.int64()))
               .append_column("length", pa.array([len(b) for b in own], pa.int64()))
               .append_column("hash", pa.array(hashes, pa.int64()))
               .append_column("text_sha256", pa.array([hashlib.sha256(b).hexdigest() for b in own]))
               .append_column("members", pa.array(members, _MEMBERS)))
        yield from out.combine_chunks().to_batches()


_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("ref", pa.int64())]))


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_rows: pa.Table | None = None
    for win in windows(batches, WINDOW_BYTES, WINDOW_ROWS):
        if open_rows is not None:
            win = pa.concat_tables([open_rows, win]).combine_chunks()
        owners, total, _ = _fold(win, [_body(t) for t in win["text"].to_pylist()])
        at = win.schema.get_field_index("n")
        out = win.take(owners).set_column(at, win.schema.field(at), pa.array(total, pa.int64()))
        last = pc.and_(pc.equal(out["length"], win["length"][-1]), pc.equal(out["hash"], win["hash"][-1]))
        open_rows = out.filter(last)
        closed = out.filter(pc.invert(last))
        if closed.num_rows:
            yield from closed.combine_chunks().to_batches()
    if open_rows is not None:
        yield from open_rows.combine_chunks().to_batches()


def local_terminals(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One record per distinct text of a window (step 1). ``carry`` keeps the other columns."""
    bounded_batches(docs.sparkSession)
    rows = wrapped(docs)
    others = [c for c in docs.columns if c != "text"] if carry else ["doc_id"]
    src = rows.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"),
        F.struct(*[F.col(f"row.`{c}`").alias(c) for c in others]).alias("rest"))
    added = T.StructType.fromDDL(
        "points bigint, ref bigint, n bigint, length bigint, hash bigint, text_sha256 string, "
        "members array<struct<doc_id: bigint, ref: bigint>>")
    out = T.StructType([*src.schema.fields, *added.fields])
    return src.mapInArrow(_local, out)


def owners(terminals: DataFrame) -> DataFrame:
    """One record per distinct text: its owner's row and the group's size (step 2)."""
    records = terminals.drop("members")
    dealt = records.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(_owners, records.schema)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    records = settled(local_terminals(docs), "exact-terminals")
    own = owners(records).select(
        "length", "hash", "text_sha256", F.col("doc_id").alias("keep_id"), F.col("ref").alias("keep_ref"),
        F.col("n").alias("group_size"))
    chunks = records.select("length", "hash", "text_sha256", "members")
    joined = chunks.join(own, ["length", "hash", "text_sha256"])
    return joined.select(F.explode("members").alias("m"), "keep_id", "keep_ref", "group_size", "text_sha256").select(
        F.col("m.doc_id").alias("doc_id"), "keep_id", "group_size",
        (F.col("m.ref") == F.col("keep_ref")).alias("kept"), "text_sha256")


def keep_owners(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, whole, in its columns."""
    own = owners(local_terminals(docs, carry=True))
    return own.select(*[F.col("text").cast(docs.schema["text"].dataType).alias(c) if c == "text"
                        else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
