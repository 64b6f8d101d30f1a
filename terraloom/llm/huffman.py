"""Token ids as canonical, length-limited Huffman code in independent blocks.

File format (a folder): `codes/` holds (id, bits), the length of each id's code; codes are canonical, by (bits,
id). `blocks/` holds one row for each block: part and row order the blocks by ascending doc_id, payload is

    magic "TLH1", then little-endian: docs u32, tokens u64, every u32, then doc_id i64 * docs, null u8 * docs,
    ids u64 * docs (ids of each document), the bit offset u64 of every `every`-th id, and the bits, high bit first.

A block needs no other block; its offsets let a reader start at any checkpoint, and let numpy decode all
stretches between checkpoints at once, one table look-up for each id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraloom.llm.common import TOKENIZER_FILE, shared_dir, staged, table, tidied
from terraloom.llm.tokens import binary_column, encoder, rows_of, tokenizer_path

LONGEST = 20
EVERY = 512
BLOCK_TOKENS = 1 << 18
_HEAD = struct.Struct("<4sIQI")


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits (package-merge); 0 for ids that do not occur."""
    bits = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return bits
    if len(used) == 1:
        bits[used] = 1
        return bits
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes of more than {longest} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels: list[np.ndarray] = []  # whether each item of a level, by weight, is a leaf
    packs = np.zeros(0)
    for _ in range(longest):
        weights = np.concatenate([leaves, packs])
        order = np.argsort(weights, kind="stable")
        levels.append(order < len(leaves))
        weights = weights[order]
        packs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    bits[used] = depth
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """The canonical code of each id."""
    codes = np.zeros(len(bits), np.uint64)
    used = np.flatnonzero(bits)
    used = used[np.lexsort((used, bits[used]))]
    code, last = 0, 0
    for i in used.tolist():
        code <<= int(bits[i]) - last
        last = int(bits[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of LONGEST bits: the id that it starts with, and its number of bits."""
    used = np.flatnonzero(bits)
    used = used[np.lexsort((used, bits[used]))]
    span = np.left_shift(1, LONGEST - bits[used].astype(np.int64))
    ids, size = np.zeros(1 << LONGEST, np.uint32), np.ones(1 << LONGEST, np.uint8)
    ids[: span.sum()] = np.repeat(used, span)
    size[: span.sum()] = np.repeat(bits[used], span)
    return ids, size


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, codes: np.ndarray, bits: np.ndarray) -> bytes:
    """One block."""
    size = bits[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    words = int(ends[-1] + 31) // 32 + 2 if len(ids) else 2
    put = codes[ids] << (64 - size - (starts & 31)).astype(np.uint64)
    at = starts >> 5  # the bits of different ids never meet, so sums are unions
    out = np.bincount(at, (put >> np.uint64(32)).astype(np.float64), words) + np.bincount(at + 1, (put & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    null = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join((
        _HEAD.pack(b"TLH1", len(doc_ids), len(ids), EVERY),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.asarray(lengths, "<u8").tobytes(),
        starts[::EVERY].astype("<u8").tobytes(), out.astype(">u4").tobytes(),
    ))


def unpack(payload: bytes, ids_of: np.ndarray, size_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, ids."""
    magic, docs, n, every = _HEAD.unpack_from(payload)
    if magic != b"TLH1":
        raise ValueError("not a block")
    at = _HEAD.size
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    null = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(payload, "<u8", docs, at + 9 * docs).astype(np.int64)
    lanes = -(-n // every)
    pos = np.frombuffer(payload, "<u8", lanes, at + 17 * docs).astype(np.int64)
    raw = np.frombuffer(payload, np.uint8, -1, at + 17 * docs + 8 * lanes).astype(np.uint32)
    words = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # the 32 bits from each byte on
    out = np.zeros((every, lanes), np.uint32)
    short = n - (lanes - 1) * every if lanes else 0
    for step in range(every if lanes > 1 else short):
        if step == short:  # the last stretch ends
            pos = pos[:-1]
        window = (words[pos >> 3] >> (32 - LONGEST - (pos & 7)).astype(np.uint32)) & np.uint32((1 << LONGEST) - 1)
        out[step, : len(pos)] = ids_of[window]
        pos = pos + size_of[window]
    ids = [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)]
    return ids, lengths, out.T.reshape(-1)[:n]


def _encoded(path: str, end_id: int, itemsize: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        for docs, ids, offs in rows_of(batches, path, end_id):
            n = docs.num_rows
            if len(ids) and int(ids.max()) >> 8 * itemsize:
                raise ValueError(f"id {int(ids.max())} needs more than {itemsize} bytes")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n)), docs.column(0), binary_column(ids.astype(f"<u{itemsize}"), offs)],
                ["part", "row", "doc_id", "ids"],
            )
            row += n

    return tidied(run)


def _counted(itemsize: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), f"<u{itemsize}"), minlength=len(total))
            got[: len(total)] += total
            total = got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return tidied(run)


def _blocks(bits: np.ndarray, itemsize: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(bits)
        held: list[tuple[int | None, bytes]] = []
        key, tokens = (0, 0), 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), f"<u{itemsize}")
            payload = pack(ids, [d for d, _ in held], np.array([len(x) // itemsize for _, x in held], np.int64), codes, bits)
            values = [[key[0]], [key[1]], [len(held)], [len(ids)], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["part", "row", "docs", "tokens", "payload"])

        for batch in batches:
            for part, row, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and ((part, row) != (key[0], key[1] + len(held)) or tokens >= BLOCK_TOKENS):
                    yield flush()
                    held, tokens = [], 0
                if not held:
                    key = (part, row)
                held.append((doc, ids))
                tokens += len(ids) // itemsize
        if held:
            yield flush()

    return tidied(run)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, *, itemsize: int | None = None) -> None:
    """Encode the texts of docs (doc_id, text) and write them to folder, in ascending doc_id order.

    Null texts are empty, null ids come first, rows with one id stay beside each other in any order and may fall into
    several parts, so one id can hold any share of the rows; a document that is empty has the end id alone.
    itemsize: bytes of an id between the passes, by default 2 for vocabularies of up to 65,536 ids, else 4.
    """
    spark = docs.sparkSession
    if itemsize is None:
        itemsize = 2 if max(encoder(path).tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    ordered = rows.repartitionByRange("doc_id", "h", "at").select("doc_id", "text").sortWithinPartitions("doc_id")
    ids = staged(ordered.mapInArrow(_encoded(path, end_id, itemsize), "part int, row long, doc_id long, ids binary"))
    counts = ids.select("ids").mapInArrow(_counted(itemsize), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    total = np.zeros(max([end_id, *(r.id for r in counts)]) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    bits = code_lengths(total)
    known = [(i, int(b)) for i, b in enumerate(bits.tolist()) if b]
    spark.createDataFrame(known, "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    blocks = ids.mapInArrow(_blocks(bits, itemsize), "part int, row long, docs long, tokens long, payload binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str, *, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from a folder; with digest ids_crc32 in place of ids.

    start counts the ids of all documents before, by sums inside each part and over the parts' totals.
    """
    codes = spark.read.schema("id long, bits int").parquet(f"{folder}/codes").collect()  # at most the vocabulary
    bits = np.zeros(max([r.id for r in codes], default=0) + 1, np.uint8)
    for r in codes:
        bits[r.id] = r.bits
    last = "ids_crc32 long" if digest else "ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, size_of = decoding_table(bits)
        for batch in batches:
            for part, row, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs, lengths, ids = unpack(payload, ids_of, size_of)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                ids = ids.astype("<u4")
                if digest:
                    out = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
                else:
                    out = binary_column(ids, ends)
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([row] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(ends[:-1]), pa.array(lengths), out],
                    ["part", "row", "doc_id", "inside", "n_tokens", last.split()[0]],
                )

    blocks = spark.read.schema("part int, row long, docs long, tokens long, payload binary").parquet(f"{folder}/blocks")
    docs = blocks.select("part", "row", "payload").mapInArrow(tidied(run), f"part int, row long, doc_id long, inside long, n_tokens long, {last}")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("of_part"))  # a row for each part
    before = F.coalesce(F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("base"))
    within = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("part", "row", within.alias("within")).join(parts, "part").select("part", "row", (F.col("base") + F.col("within")).alias("first"))
    return docs.join(starts, ["part", "row"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", last.split()[0])


def op6_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path(TOKENIZER_FILE), 2)
    return read_tokens(spark, folder, digest=True)
