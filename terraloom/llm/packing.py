"""Hierarchical packing of token ids into context windows of several sizes.

Documents are taken in runs of neighbouring rows; a run is bounded by its ids, never crosses an input partition,
and is packed by itself, so no row moves between machines and no key can be hot. Inside a run a document gives
whole windows of the largest size; what is left goes to the smallest tier that holds it. From the largest tier
down, each remainder opens a window, whose gap is filled with the largest remainders of shorter tiers that fit,
then by cutting one. The one window that a run leaves open goes, with its ids, to a second pass, in which the open
windows of many runs, dealt to groups of bounded size, are packed in the same way; only a group's last window is
cut into windows of a power of two, so that no id is padding. Windows of a tier are dealt into step groups with equal
numbers of ids, heavy and light ones in turn; a step group lies in one run or group.

Null texts are empty; an empty document holds its end id alone. Repeated rows are packed like others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import TOKENIZER_FILE, staged, table, tidied
from terraloom.llm.tokens import rows_of, tokenizer_path

WINDOW = 1024
TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 16_384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

Piece = tuple[int, int, int]  # document, start, length


def pack_run(lengths: list[int], tiers: tuple[int, ...] = TIERS, *, last: bool = True) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows (size, pieces) that hold every id of documents with so many ids exactly once, and pieces left over.

    Every window is full: its pieces' lengths sum to its size, which is a tier or, at the end, a power of two. Unless
    it is the last run, the pieces of the window that stays open are left over, fewer ids than the largest tier.
    """
    left: list[Piece] = []
    top = tiers[0]
    windows: list[tuple[int, list[Piece]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start) of remainders, ascending
    for doc, n in enumerate(lengths):
        whole = n // top
        windows += [(top, [(doc, k * top, top)]) for k in range(whole)]
        if n % top:
            pool.append((n % top, doc, whole * top))
    pool.sort()
    for tier in tiers:
        while pool and (pool[-1][0] > tier // 2 or tier == tiers[-1]):
            size, doc, start = pool.pop()
            held, gap = [(doc, start, size)], tier - size
            while gap and pool:
                k = bisect_right(pool, gap, key=lambda x: x[0])
                if k:  # the largest that fits
                    size, doc, start = pool.pop(k - 1)
                    held.append((doc, start, size))
                    gap -= size
                else:  # none fits: cut the smallest
                    size, doc, start = pool.pop(0)
                    held.append((doc, start, gap))
                    insort(pool, (size - gap, doc, start + gap))
                    gap = 0
            if not gap:
                windows.append((tier, held))
            elif last:
                windows += _powers(held, tier - gap)
            else:
                left += held
    return windows, left


def _powers(pieces: list[Piece], total: int) -> list[tuple[int, list[Piece]]]:
    """The pieces dealt anew, in order, into full windows of powers of two."""
    out, rest = [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            need, held = 1 << bit, []
            while need:
                doc, start, size = rest.pop(0)
                held.append((doc, start, min(size, need)))
                if size > need:
                    rest.insert(0, (doc, start + need, size - need))
                need -= min(size, need)
            out.append((1 << bit, held))
    return out


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int = STEP_TOKENS) -> list[int]:
    """For each window a group; groups have windows of one size, as many as step_tokens holds, and like costs."""
    groups, first = [0] * len(windows), 0
    by_size: dict[int, list[int]] = {}
    for i, (size, _) in enumerate(windows):
        by_size.setdefault(size, []).append(i)
    for size, own in sorted(by_size.items(), reverse=True):
        n = -(-len(own) // max(1, step_tokens // size))
        own.sort(key=lambda i: -sum(x[2] ** 2 for x in windows[i][1]))
        for rank, i in enumerate(own):
            lap, k = divmod(rank, n)
            groups[i] = first + (n - 1 - k if lap % 2 else k)
        first += n
    return groups


def _rows(windows: list[tuple[int, list[Piece]]], names: list[int | None], starts: list[int], totals: list[int], ids: np.ndarray, first: list[int], sequence: int, group: int) -> tuple[list[tuple], int]:
    """Rows of SCHEMA for windows of documents (or pieces that begin at starts), and the number of step groups."""
    groups, rows = step_groups(windows), []
    for k, (size, pieces) in enumerate(windows):
        offset = 0
        for doc, start, n in pieces:
            at = first[doc] + start
            rows.append((names[doc], starts[doc] + start, n, zlib.crc32(ids[at : at + n]), totals[doc], sequence + k, offset, size, group + groups[k]))
            offset += n
    return rows, max(groups, default=-1) + 1


def _batch(rows: list[tuple], extra: list[bytes | None] | None = None) -> pa.RecordBatch:
    names, kinds = [x.split()[0] for x in SCHEMA.split(", ")], [pa.int32() if x.endswith(" int") else pa.int64() for x in SCHEMA.split(", ")]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns if extra is None else [*columns, pa.array(extra, pa.binary())], names if extra is None else [*names, "ids"])


def packed(docs: DataFrame, path: str, end_id: int, *, tiers: tuple[int, ...] = TIERS, run_bytes: int = 8 << 20) -> DataFrame:
    """One row for each piece of docs (doc_id, text); see SCHEMA. run_bytes bounds the text of a run (one document at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = group = TaskContext.get().partitionId() << 40
        for part, ids, offs in rows_of(batches, path, end_id, run_bytes):
            lengths = np.diff(offs).tolist()
            windows, left = pack_run(lengths, tiers, last=False)
            names, first, ids = part.column(0).to_pylist(), offs.tolist(), ids.astype("<u4")
            rows, groups = _rows(windows, names, [0] * len(names), lengths, ids, first, sequence, group)
            sequence, group = sequence + len(windows), group + groups
            open_ = [(names[doc], start, n, None, lengths[doc], None, None, None, None) for doc, start, n in left]
            held = [ids[first[doc] + start : first[doc] + start + n].tobytes() for doc, start, n in left]
            yield _batch(rows + open_, [None] * len(rows) + held)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = 1 << 62 | TaskContext.get().partitionId() << 40
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
        if rows:
            names, starts, totals, held = (list(x) for x in zip(*rows, strict=True))
            ids = np.frombuffer(b"".join(held), "<u4")
            lengths = [len(x) // 4 for x in held]
            first = np.concatenate([[0], np.cumsum(lengths)]).tolist()
            windows, _ = pack_run(lengths, tiers)
            yield _batch(_rows(windows, names, starts, totals, ids, first, place, place)[0])

    once = staged(docs.select("doc_id", "text").mapInArrow(tidied(run), f"{SCHEMA}, ids binary"))
    done = once.where("ids IS NULL").drop("ids")
    left = once.where("ids IS NOT NULL")
    size = left.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    groups = max(1, -(-size // run_bytes))
    dealt = left.select("doc_id", "start", "doc_tokens", "ids", F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(groups)).cast("int").alias("g"))
    dealt = dealt.repartitionById(groups, F.col("g")).select("doc_id", "start", "doc_tokens", "ids")
    return done.union(dealt.mapInArrow(tidied(again), SCHEMA))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER_FILE), 0)
