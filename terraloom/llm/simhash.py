"""Near duplicates by 64-bit SimHash, found with the binary Golay code.

A fingerprint has bits A (0-22), B (23-45) and C (46-63). The perfect Golay code of length 23 has one codeword
within three errors of any word, and one or six within four; two words that differ in at most two bits share one
of those (the word halfway between them is within three errors of a codeword). Fingerprints that differ in four
bits at most have either at most two errors in A and at most two in B: they share a key (codeword of A, codeword
of B); or three or more in A, so at most one in B and C together: they share B, or C and a codeword of B; or
three or more in B: they share A, or C and a codeword of A. So no link is lost, whatever the data.

Equal fingerprints are one row before keys are made. Inside a bucket a search from fingerprint to fingerprint
compares with those not yet reached and gives a spanning forest of the links, at most one row for each member,
with the same components as all links. Buckets beyond HOT rows are dealt to blocks that meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import spread_join, staged, table, tidied
from terraloom.llm.components import components

BITS = 4
HOT = 20_000
SEED = 42
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the code's generator polynomial


def fingerprint(text: str | None, words: int = 4, seed: int = SEED) -> int:
    """Unsigned; 0 for texts without words."""
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not parts:
        return 0
    line = b" ".join(parts)
    size = list(map(len, parts))
    ends = [e + i for i, e in enumerate(accumulate(size))]
    starts = [e - n for e, n in zip(ends, size, strict=True)]
    digest = xxhash.xxh64_intdigest
    last = min(words, len(parts)) - 1
    counts, n = np.zeros(64, np.int64), len(parts) - last
    for at in range(0, n, 1 << 16):  # hashes of a long text are held in portions
        h = np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[last + at :], strict=False)], np.uint64)
        counts += bits_set(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def with_fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = np.array([fingerprint(x.as_py(), words) for x in part.column(1)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, fp long")


@cache
def _nearby() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the errors of at most four bits that lead to a codeword (-1: none), and syndromes of 23-bit words by halves."""

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= _GENERATOR << (bit - 11)
        return x

    single = [syndrome(1 << i) for i in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for n in range(5):
        for places in combinations(range(23), n):
            s = e = 0
            for p in places:
                s ^= single[p]
                e |= 1 << p
            found[s].append(e)
    widest = max(map(len, found))
    errors = np.array([x + [-1] * (widest - len(x)) for x in found], np.int64)
    halves = np.array([[syndrome(x << shift) if x << shift < 1 << 23 else 0 for x in range(4096)] for shift in (0, 12)], np.int64)
    return errors, halves


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of nearby codewords' upper 12 bits (which tell them apart), and which of them exist."""
    errors, halves = _nearby()
    e = errors[halves[0][words & 4095] ^ halves[1][words >> 12]]
    return (words[:, None] ^ e) >> 11, e >= 0


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) of every key; equal keys are equal in kind and content."""
    a, b, c = fps & 0x7FFFFF, fps >> 23 & 0x7FFFFF, fps >> 46 & 0x3FFFF
    (ka, ma), (kb, mb) = codewords(a), codewords(b)
    at = np.arange(len(fps))
    found: list[tuple[np.ndarray, np.ndarray]] = [(at, 1 << 60 | a), (at, 2 << 60 | b)]
    for i in range(ka.shape[1]):
        found += [(at[ma[:, i]], (3 << 60 | c << 12 | ka[:, i])[ma[:, i]]), (at[mb[:, i]], (4 << 60 | c << 12 | kb[:, i])[mb[:, i]])]
        for j in range(kb.shape[1]):
            both = ma[:, i] & mb[:, j]
            found.append((at[both], (5 << 60 | ka[:, i] << 12 | kb[:, j])[both]))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _differing(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it counts the absolute value's bits


def _forest(members: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Links that join the same fingerprints as all links among distinct members do."""
    left = members
    todo: list[int] = []
    while len(left) or todo:
        if not todo:
            todo.append(int(left[0]))
            left = left[1:]
        at = todo.pop()
        near = _differing(left, np.int64(at)) <= bits
        if near.any():
            for x in left[near].tolist():
                yield at, x
                todo.append(x)
            left = left[~near]


def _links_of_sorted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal (key, block) of sorted rows."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = (np.zeros(0, np.int64),) * 3

    def links(k: np.ndarray, block: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        out: set[tuple[int, int]] = set()
        cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (block[1:] != block[:-1])]))
        size = np.diff(np.append(cut, len(k)))
        for n in np.unique(size[(size > 1) & (size <= 8)]).tolist():  # small buckets: all at once
            rows = fp[cut[size == n][:, None] + np.arange(n)]
            for i, j in combinations(range(n), 2):
                near = _differing(rows[:, i], rows[:, j]) <= bits
                out.update(zip(rows[near, i].tolist(), rows[near, j].tolist(), strict=True))
        for at, n in zip(cut[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            out.update(_forest(np.unique(fp[at : at + n]), bits))
        pairs = [(a, b) for a, b in out if a != b]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], schema=kind)

    for batch in batches:
        k, block, fp = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
        if not len(k):
            continue
        first = int(np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (block[1:] != block[:-1])]))[-1])
        held = (k[first:], block[first:], fp[first:])  # the last bucket may go on
        if first:
            yield links(k[:first], block[:first], fp[:first])
    if len(held[0]):
        yield links(*held)


def near_links(fps: DataFrame, *, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links (a, b) among distinct fingerprints fps (fp) with the components of all pairs within `bits` <= 4 bits."""
    if bits > 4:
        raise ValueError("the keys find up to four differing bits")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(at, 4096).to_numpy()
                i, k = keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(own[i])], ["k", "fp"])

    found = fps.select("fp").mapInArrow(tidied(expand), "k long, fp long")
    # keys of more than hot fingerprints: one in `hot` of all keys at most, so this side is small beside the other;
    # written, so that its size is known and few such keys need no shuffle of all keys
    large = found.groupBy("k").agg(F.count("*").alias("rows")).where(F.col("rows") > hot)
    large = staged(large.select("k", F.ceil(F.col("rows") / hot).cast("int").alias("n")))
    block = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    # block i meets block j in the bucket (i, j); a cool bucket is one block
    pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: (F.least(F.col("i"), j) * F.col("n") + F.greatest(F.col("i"), j)).cast("long"))
    dealt = found.join(large, "k", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("i", block)
    dealt = dealt.select("k", F.explode(pair).alias("block"), "fp")
    dealt = dealt.repartition("k", "block").sortWithinPartitions("k", "block")
    return dealt.mapInArrow(tidied(lambda batches: _links_of_sorted(batches, bits)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, words: int = 4, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of each row of docs (doc_id, text).

    Rows whose fingerprints are linked, over any number of links, have one component_id, their least doc_id (null
    if none has an id). Texts without words have fingerprint 0. Repeated rows are linked by equal fingerprints.
    """
    rows = staged(with_fingerprints(docs, words))
    per = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    groups = components(near_links(per, bits=bits))
    joined = staged(per.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(joined.select("fp", "root"), least.drop("n"), ["root"], least.select("root", "n"))
    return spread_join(rows, named, ["fp"], per.select("fp", "n")).select("doc_id", "fp", "root", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
