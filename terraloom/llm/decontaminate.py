"""Removal of benchmark text: word windows of test items, looked up in every window of every document.

The windows of the test items go to all executors as sorted hashes with the words behind them, in portions of a
bounded size; benchmarks beyond one portion take one pass for each, in which every row carries what the passes
before found, so no row is shuffled or looked up by its id. A hit of the hash is held against the words, so
collisions count for nothing.

Words are runs of 0-9, a-z (A-Z in lower case) and characters beyond ASCII. Null texts have no words. Repeated
rows and rows without an id are kept, each with its own result. Items without an id are searched for like all
others and count as hits, but have no name in the list of items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import staged, table, text_slices, tidied

WINDOW = 10
PORTION_BYTES = 8 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)
HITS = "n_words long, positions array<long>, items array<long>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words one after another, and the offsets of each text's words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].to_pybytes()[offs[0] : offs[-1]] if texts.buffers()[2] else b""
    folded = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offs - offs[0]).tobytes()), pa.py_buffer(data.translate(_FOLD))])
    lists = pc.ascii_split_whitespace(folded)
    words, ends = lists.flatten(), np.asarray(lists.offsets, np.int64)
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # blanks at either end give empty words
    return words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends - ends[0]].astype(np.int64)


def _hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        out = (out ^ rows[:, j].astype(np.uint64)) * _MULT
        out ^= out >> np.uint64(29)
    return out


class Windows:
    """The distinct windows of some items, by length."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int) -> None:
        self.names = [i for i, _ in items]
        words, offs = words_of(pa.array([t for _, t in items], pa.large_string()))
        coded = words.dictionary_encode()
        self.vocabulary, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        n = np.diff(offs)
        self.by_size = {}
        for size in np.unique(np.minimum(n, window)[n > 0]).tolist():
            own = np.flatnonzero(np.minimum(n, window) == size)
            count = n[own] - size + 1
            item = np.repeat(own, count)
            starts = np.repeat(offs[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            rows = ids[starts[:, None] + np.arange(size)]
            hashes = _hash(rows)
            order = np.lexsort((item, hashes))
            hashes, rows, item = hashes[order], rows[order], item[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1]).any(1)]))
            # a window, and where its items start and end; colliding windows may stand there in several places
            self.by_size[size] = (hashes[first], rows[first], item, np.append(first, len(item)))

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, int, list[int]]]:
        """(text, word position in it, words, items) of each window that occurs."""
        words, offs = words_of(texts)
        ids = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for size, (hashes, rows, item, bound) in self.by_size.items():
            starts = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else np.zeros(0, np.int64)
            text = np.searchsorted(offs, starts, "right") - 1
            inside = starts + size <= offs[np.minimum(text + 1, len(offs) - 1)]
            starts, text = starts[inside], text[inside]
            for at in range(0, len(starts), 1 << 20):
                some = starts[at : at + (1 << 20)]
                seen = ids[some[:, None] + np.arange(size)]
                h = _hash(seen)
                k = np.searchsorted(hashes, h)
                while True:  # equal hashes of different windows stand side by side
                    live = (k < len(hashes)) & (hashes[np.minimum(k, len(hashes) - 1)] == h)
                    if not live.any():
                        break
                    same = np.flatnonzero(live)
                    same = same[(rows[k[same]] == seen[same]).all(1)]
                    for j in same.tolist():
                        yield int(text[at + j]), int(some[j] - offs[text[at + j]]), size, [n for i in item[bound[k[j]] : bound[k[j] + 1]].tolist() if (n := self.names[i]) is not None]
                    k = np.where(live, k + 1, len(hashes))
        self.n_words = np.diff(offs)


def _portions(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items with words, in portions of about `limit` bytes, one at a time on the driver."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        held.append((r.item_id, r.text))
        size += len(r.text.encode())
        if size >= limit:
            yield held
            held, size = [], 0
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, portion_bytes: int = PORTION_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) with n_words, positions (words hit, ascending) and items (that occur, ascending).

    keep: more columns of docs to carry.
    """
    spark = docs.sparkSession

    def scan(rows: DataFrame, shared, carried: tuple[str, ...], more: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Windows(shared.value, window)
            for part in text_slices(batches, "text"):
                at_name = part.schema.get_field_index
                old = [part.column(at_name(c)).to_pylist() for c in ("positions", "items")] if more else [[()] * part.num_rows] * 2
                covered, items = ({i: set(x) for i, x in enumerate(column) if x} for column in old)
                for text, at, size, names in find.hits(part.column(at_name("text"))):
                    covered.setdefault(text, set()).update(range(at, at + size))
                    items.setdefault(text, set()).update(names)
                n = part.num_rows
                columns = [part.column(at_name(c)) for c in carried]
                columns += [pa.array(find.n_words), pa.array([sorted(covered.get(i, ())) for i in range(n)], pa.list_(pa.int64())), pa.array([sorted(items.get(i, ())) for i in range(n)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [*carried, "n_words", "positions", "items"])

        schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried] + [HITS])
        return rows.mapInArrow(tidied(run), schema)

    wanted = tuple(dict.fromkeys([*keep, "doc_id"]))
    out, waiting = docs.select(*dict.fromkeys([*wanted, "text"])), None
    for k, portion in enumerate(_portions(benchmark, portion_bytes)):
        if waiting is not None:  # written, so that one pass alone holds a portion in memory
            out = staged(scan(out, waiting, tuple(dict.fromkeys([*wanted, "text"])), k > 1))
        waiting, last = spark.sparkContext.broadcast(portion), k > 0
    return scan(out, waiting, wanted, last)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", F.size("positions").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("positions") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents of docs, all columns, in which no window of the benchmark occurs.

    Each row goes or stays by its own text: the scan carries all columns, so no id is looked up.
    """
    plain = [f"_c{i}" for i in range(len(docs.columns))]  # names apart from those of the scan's results
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, plain, strict=True) if c not in ("doc_id", "text")], "doc_id", "text")
    names = {c: c if c in ("doc_id", "text") else n for c, n in zip(docs.columns, plain, strict=True)}
    found = contamination(rows, benchmark, keep=tuple(names.values())).where(F.size("positions") == 0)
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])


OP8_SQL = """
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), sizes AS (SELECT DISTINCT least(10, len(w)) AS n FROM words WHERE kind = 'i' AND len(w) > 0
), item_windows AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM words WHERE kind = 'i' AND len(w) > 0)
), doc_windows AS (
  SELECT id AS doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, sizes WHERE kind = 'd' AND len(w) >= n)
), hits AS (SELECT DISTINCT doc_id, d.n, p, item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.g = i.g
), covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered ON id = covered.doc_id LEFT JOIN items ON id = items.doc_id WHERE kind = 'd'
"""
