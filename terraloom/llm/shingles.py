"""Near duplicates by the Jaccard similarity of their word shingles, found by SimHash and MinHash, verified exactly.

Candidates come from two sources. SimHash fingerprints of the shingles are linked at four differing bits by the
binary Golay code (see simhash), which finds near copies from a similarity of about 0.95 on. At 0.8 two fingerprints
of 64 bits differ in about 10; words of 23 bits that differ so much share any nearby Golay codeword with probability
0.6, so pairs of them (a key of 24 bits, 28 keys each) would need hundreds of keys a text, of which each meets one text in 20,000
by chance. So, for what lies between, each text also gets BANDS keys of ROWS minima; texts of similarity s
share one with probability 1 - (1 - s^ROWS)^BANDS, that is 0.99994 at 0.8. Texts that are candidates of each other, over
any number of steps, form a group; inside a group the shingles themselves decide, of all pairs that an exact prefix
filter leaves, so no link is below the similarity and only a pair in no common group can be missed.

Groups beyond HOT texts are dealt to blocks that meet in pairs. Inside a block a search from text to text gives a
spanning forest of the links, so a group of near copies makes no quadratic number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm.common import discard, spread_join, staged, text_slices, tidied
from terraloom.llm.components import components
from terraloom.llm.simhash import bits_set, near_links

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
HOT = 4_000
SEED = 42
_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct runs of `words` words, ascending; of the whole text if it has fewer; none without words."""
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    size = list(map(len, parts))
    ends = [e + i for i, e in enumerate(accumulate(size))]
    starts = [e - n for e, n in zip(ends, size, strict=True)]
    digest = xxhash.xxh64_intdigest
    last = min(words, len(parts)) - 1
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[last:], strict=False)], np.uint64))


def keys(own: np.ndarray) -> np.ndarray:
    """The keys of a text's shingles, one for each band; texts without shingles have one of their own."""
    if not len(own):
        return np.zeros(1, np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (own >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, ((short[at : at + 1024, None] ^ _XOR) * _ODD).min(0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MULT
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = (out ^ column) * _MULT
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links (i, j) that join the same sets as all pairs of the similarity do; sets without members are alike."""
    size = np.array(list(map(len, sets)), np.int64)
    bare = np.flatnonzero(size == 0)
    yield from ((int(bare[0]), int(i)) for i in bare[1:])
    _, ids = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    offs = np.concatenate([[0], np.cumsum(size)])
    often = np.bincount(ids)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(ids, kind="stable")]
    first = np.concatenate([[0], np.cumsum(often)])
    left, marked = size > 0, np.zeros(len(often), bool)
    n_left = int(left.sum())
    for start in np.flatnonzero(left).tolist():
        if not left[start]:
            continue
        left[start] = False
        n_left -= 1
        todo = [start]
        while todo and n_left:
            at = todo.pop()
            own = ids[offs[at] : offs[at + 1]]
            # a set that shares so much holds one of the rarest of own's members
            some = own[np.argsort(often[own], kind="stable")][: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1]
            near = np.unique(np.concatenate([x[left[x]] for x in (holders[first[s] : first[s + 1]] for s in some.tolist())]))
            if not len(near):
                continue
            marked[own] = True
            shared = np.array([np.count_nonzero(marked[ids[offs[j] : offs[j + 1]]]) for j in near.tolist()])
            marked[own] = False
            near = near[shared / (len(own) + size[near] - shared) >= similarity]
            left[near] = False
            n_left -= len(near)
            todo += near.tolist()
            yield from ((at, j) for j in near.tolist())


def _links_of_sorted(batches: Iterator[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links within each run of equal (root, block) of sorted rows (root, block, node, text)."""
    place, nodes, sets = None, [], []

    def links() -> pa.RecordBatch:
        pairs = [(nodes[i], nodes[j]) for i, j in forest(sets, similarity)]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for root, block, node, text in zip(*(batch.column(i) for i in range(4)), strict=True):
            if (here := (root.as_py(), block.as_py())) != place:
                if len(nodes) > 1:
                    yield links()
                place, nodes, sets = here, [], []
            nodes.append(node.as_py())
            sets.append(shingles(text.as_py(), words))
    if len(nodes) > 1:
        yield links()


def node_of(text: str = "text") -> Column:
    """The name of a text: equal texts have one, whatever their ids."""
    return F.xxhash64(text)


def near_groups(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(doc_id, node, root) of each row of docs (doc_id, text): rows of one root are near duplicates.

    Texts whose shingles have the similarity are linked, and texts linked over any number of steps are one group.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            sets = [shingles(x.as_py(), words) for x in batch.column(2)]
            fps = np.array([np.packbits(bits_set(x) * 2 > len(x), bitorder="little").view("<i8")[0] if len(x) else 0 for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), pa.array([keys(x) for x in sets], pa.list_(pa.int64()))], ["doc_id", "node", "fp", "keys"])

    texts = docs.select("doc_id", node_of().alias("node"), "text")
    rows = staged(texts.mapInArrow(tidied(sketch), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, fp long, keys array<long>"))
    per = staged(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    # equal fingerprints and those within four bits: each text is linked to the first of its fingerprint's component
    alike = per.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    by_print = spread_join(per.select("node", "fp"), alike.select("fp", F.col("first").alias("a")), ["fp"], alike.select("fp", "n")).select("a", F.col("node").alias("b"))
    near = near_links(alike.select("fp"))
    first = alike.select("fp", "first")
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # equal keys: each text is linked to the least of its key
    found = staged(per.select("node", F.explode("keys").alias("k")))
    shared = found.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("a <> z")
    by_key = spread_join(found, shared.select("k", "a"), ["k"], shared.select("k", "n")).select("a", F.col("node").alias("b"))
    groups = staged(components(by_key.where("a <> b").union(by_print.where("a <> b")).union(near)))
    discard(found)
    size = groups.groupBy("root").agg(F.count("*").alias("n"))
    parts = size.select("root", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    # one row of each text in a group, dealt to blocks: block i meets block j in (i, j). The table is written, so
    # that its size is known and a small one meets the texts without a shuffle of them
    members = spread_join(groups, parts, ["root"], size).join(per.select("node", "least"), "node")
    members = staged(members.select(F.col("node").alias("_node"), "least", "root", F.col("parts").alias("n")))
    one = texts.join(members, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["node"])
    i = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: (F.least(i, j) * F.col("n") + F.greatest(i, j)).cast("long"))
    dealt = one.select("root", F.explode(pair).alias("block"), "node", "text").repartition("root", "block").sortWithinPartitions("root", "block")
    links = dealt.mapInArrow(tidied(lambda batches: _links_of_sorted(batches, words, similarity)), "a long, b long")
    linked = components(links).withColumnRenamed("node", "_node")
    roots = per.select("node").join(linked, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("root", "node").alias("root"))
    return spread_join(rows.select("doc_id", "node"), roots, ["node"], per.select("node", "n")).select("doc_id", "node", "root")


def one_of_each(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates by word shingles: that of the least doc_id.

    Groups are of texts, so rows of one doc_id or of none are told apart by their texts, and a row whose text is
    linked to no other stays whatever its id. Rows without an id come after all others.
    """
    found = near_groups(docs, words=words, similarity=similarity)
    # the first row by (has an id, id, text) names the text that stays for its group
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "node")).alias("best"))
    # one key of text and id, so that the join and the choice among rows equal in both need one shuffle of the texts
    key = lambda node, doc_id: F.concat_ws(":", F.col(node).cast("string"), F.col(doc_id).cast("string"))
    keep = best.select(key("best.node", "best.doc_id").alias("key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node_of().alias("node"), "doc_id")
    own = rows.select("row", key("node", "doc_id").alias("key")).join(keep, "key", "left_semi")
    return own.dropDuplicates(["key"]).select("row.*")
