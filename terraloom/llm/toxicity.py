"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

Tokens are parts between white space, lower-cased, without punctuation at their ends. Labels exist for whole
documents, so token labels are derived: a word (or a word's first four or five letters) is a marker if it is far
more frequent, by documents, under label 1 than under label 0; the tokens with a marker in documents of label 1
are toxic. The field has two states; a token's potential is the sum of weights for its word, its first letters,
which also tell on words never seen, and the words before and behind it. It is trained by gradient ascent on the
log-likelihood, the expectations by forward-backward. A chain is a whole document: blocks of tokens are run through
side by side as products of 2x2 matrices, messages go from block to block, and a second run inside the blocks starts
from them. A document's score is a logistic function of its largest marginal and of its expected number of toxic
tokens.

Null and empty texts have no tokens: their score is that of a document without a toxic token. Without labels of both
kinds nothing can be learnt, and all documents get one low score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import table, text_slices, tidied

BLOCK = 64  # tokens that one step of the matrix products takes in
SAMPLE_BYTES = 2 << 20  # text of toxic documents that is learnt from, about
CLEAN = 4  # as much text of other documents
STRETCH = 1 << 16  # characters of one text that is learnt from; of longer ones a stretch chosen by a hash
THRESHOLD = 0.7
_ENDS = ".,;:!?\"'()[]{}<>«»“”„…-*_"
SCORES = "score double, toxic_tokens long, spans string"


@dataclass
class Model:
    weights: dict[str, float]  # of words ("=word") and first letters ("4:lett", "5:lette")
    bias: float
    moves: np.ndarray  # log potentials of state changes
    document: np.ndarray  # of the logistic function: constant, largest marginal's logit, expected tokens


def clean(token: str) -> str:
    return token.strip(_ENDS)


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased tokens, dictionary-encoded, one text after another, and each text's offsets."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat, ends = lists.flatten(), np.asarray(lists.offsets, np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(full)).dictionary_encode(), np.concatenate([[0], np.cumsum(full)])[ends - ends[0]].astype(np.int64)


class Chains:
    """The places of tokens in blocks: rows are steps, columns are blocks, those of a document side by side."""

    def __init__(self, offsets: np.ndarray) -> None:
        n = np.diff(offsets)
        self.blocks = -(-n // BLOCK)
        first = np.concatenate([[0], np.cumsum(self.blocks)])
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
        self.step, self.column = at % BLOCK, np.repeat(first[:-1], n) + at // BLOCK
        self.width = int(first[-1])
        self.live = np.zeros((BLOCK, self.width), bool)
        self.live[self.step, self.column] = True
        own = np.flatnonzero(self.blocks)
        self.own = own[np.argsort(-self.blocks[own], kind="stable")]  # documents, those with most blocks first
        self.head = first[self.own]
        self.heads = np.zeros(self.width, bool)
        self.heads[self.head] = True
        self.longest = int(self.blocks.max()) if len(n) else 0

    def _lap(self, r: int) -> np.ndarray:
        """The r-th block of each document that has one."""
        return self.head[: int(np.searchsorted(-self.blocks[self.own], -r, "left"))] + r

    def marginals(self, potential: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of each token, and expected state changes (2x2)."""
        e = np.zeros((BLOCK, self.width))
        e[self.step, self.column] = np.clip(potential, -30, 30)
        e, m = np.exp(e), np.exp(moves)
        # a block's matrix: from the state before its first token to that of its last
        f = np.zeros((2, 2, self.width))
        f[0, 0] = f[1, 1] = 1
        for t in range(BLOCK):
            now = np.stack([f[:, 0] * m[0, 0] + f[:, 1] * m[1, 0], (f[:, 0] * m[0, 1] + f[:, 1] * m[1, 1]) * e[t]], 1)
            now /= now.sum((0, 1))
            f = np.where(self.live[t], now, f)
        # messages into blocks; the first token of a document has no move before it
        into = np.zeros((2, self.width))
        for r in range(1, self.longest):
            at = self._lap(r)
            before = at - 1
            if r == 1:
                # the first block anew, without the move: its own pass from the first token
                a = np.stack([np.ones(len(before)), e[0, before]])
                for t in range(1, BLOCK):
                    a = np.stack([a[0] * m[0, 0] + a[1] * m[1, 0], (a[0] * m[0, 1] + a[1] * m[1, 1]) * e[t, before]])
                    a /= a.sum(0)
            else:
                a = into[0, before] * f[0][:, before] + into[1, before] * f[1][:, before]
            into[:, at] = a / a.sum(0)
        out = np.full((2, self.width), 0.5)  # messages back to blocks' last tokens
        for r in range(self.longest - 1, 0, -1):
            at = self._lap(r)
            b = f[:, 0, at] * out[0, at] + f[:, 1, at] * out[1, at]
            out[:, at - 1] = b / b.sum(0)
        a = np.zeros((BLOCK, 2, self.width))
        before = None
        for t in range(BLOCK):
            past = into if t == 0 else before
            now = np.stack([past[0] * m[0, 0] + past[1] * m[1, 0], (past[0] * m[0, 1] + past[1] * m[1, 1]) * e[t]])
            if t == 0:
                now = np.where(self.heads, np.stack([np.ones(self.width), e[0]]), now)
            total = now.sum(0)
            before = a[t] = np.where(self.live[t], now / np.where(total > 0, total, 1), now if before is None else before)
        b = out
        p, changes = np.zeros((BLOCK, self.width)), np.zeros((2, 2))
        for t in range(BLOCK - 1, -1, -1):
            on = self.live[t]
            both = a[t] * b
            both /= both.sum(0)
            p[t] = both[1]
            past = into if t == 0 else a[t - 1]
            moved = on & ~self.heads if t == 0 else on
            to = np.stack([b[0], b[1] * e[t]])
            pair = past[:, None] * m[:, :, None] * to[None]
            total = pair.sum((0, 1))
            changes += (pair / np.where(total > 0, total, 1) * moved).sum(2)
            if t:
                back = np.stack([m[0, 0] * to[0] + m[0, 1] * to[1], m[1, 0] * to[0] + m[1, 1] * to[1]])
                b = np.where(on, back / back.sum(0), b)
        return p[self.step, self.column], changes


def markers(doc: np.ndarray, feature: np.ndarray, n: int, label: np.ndarray, least: float = 3.0) -> np.ndarray:
    """Which of n features have log-odds under label 1 above `least`, by the documents they occur in."""
    pairs = np.unique(doc * n + feature)
    toxic = label[pairs // n] == 1
    held = [np.bincount(pairs[at] % n, minlength=n) for at in (toxic, ~toxic)]
    odds = np.log((held[0] + 0.5) / ((label == 1).sum() + 1)) - np.log((held[1] + 0.5) / ((label == 0).sum() + 1))
    return odds > least


def neighbours_of(types: np.ndarray, offsets: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The types of the tokens before and behind each token; none at a document's ends."""
    before, behind = np.full(len(types), none), np.full(len(types), none)
    before[1:], behind[:-1] = types[:-1], types[1:]
    full = np.flatnonzero(np.diff(offsets))
    before[offsets[full]] = none
    behind[offsets[full + 1] - 1] = none
    return before, behind


def train(rows: list[tuple[str, int]], *, rounds: int = 40) -> Model:
    """From (text, label of the document); rows is a bounded sample."""
    if not any(y for _, y in rows) or all(y for _, y in rows):
        return Model({}, -10.0, np.zeros((2, 2)), np.array([-3.0, 0.0, 0.0]))
    coded, offs = tokens_of(pa.array([t for t, _ in rows], pa.large_string()))
    words = pc.utf8_trim(coded.dictionary, characters=_ENDS).dictionary_encode()
    types = words.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
    words = words.dictionary
    label = np.array([y for _, y in rows])
    doc = np.repeat(np.arange(len(label)), np.diff(offs))
    spaces, toxic_type = [], np.zeros(len(words), bool)
    for prefix, size in (("=", None), ("4:", 4), ("5:", 5)):
        part = (words if size is None else pc.utf8_slice_codeunits(words, 0, size)).dictionary_encode()
        own = part.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        long = pc.utf8_length(part.dictionary).to_numpy(zero_copy_only=False) >= (size or 4)
        marked = markers(doc, own[types], len(part.dictionary), label) & long
        toxic_type |= marked[own]
        spaces.append((prefix, part.dictionary, own))
    y = (toxic_type[types] & (label[doc] == 1)).astype(float)
    before, behind = neighbours_of(types, offs, len(words))
    beside = np.zeros(len(words) + 1, bool)  # words that stand next to toxic tokens, more than once
    often = np.bincount(before[y == 1], minlength=len(words) + 1) + np.bincount(behind[y == 1], minlength=len(words) + 1)
    beside[:-1] = often[:-1] > 1
    # a matrix of weights for each place: the word itself by its features, the words beside it by their own
    pairs, names = [], []
    for prefix, dictionary, own in spaces:  # the features of words that hold a marker
        used = np.unique(own[toxic_type])
        at = np.full(len(dictionary), -1)
        at[used] = np.arange(len(names), len(names) + len(used))
        names += [prefix + dictionary[int(k)].as_py() for k in used]
        held = np.flatnonzero(at[own] >= 0)
        pairs.append(np.stack([held, at[own[held]]], 1))
    pairs = np.concatenate(pairs)
    near = np.flatnonzero(beside)
    sides = {}
    for prefix in ("<", ">"):
        sides[prefix] = np.full(len(words) + 1, -1)
        sides[prefix][near] = np.arange(len(names), len(names) + len(near))
        names += [prefix + words[int(k)].as_py() for k in near]
    chains = Chains(offs)
    inner = np.ones(len(types), bool)
    inner[offs[:-1][np.diff(offs) > 0]] = False
    follow = np.flatnonzero(inner)
    state = y.astype(np.int64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[follow - 1], state[follow]), 1)
    w, bias, moves = np.zeros(len(names)), -4.0, np.zeros((2, 2))
    scale = max(1.0, y.sum())
    speed = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]
    square = [np.zeros(len(names)), 0.0, np.zeros((2, 2))]

    def potentials() -> np.ndarray:
        own, at = np.full(len(words), bias), np.append(w, 0.0)
        np.add.at(own, pairs[:, 0], w[pairs[:, 1]])
        return own[types] + at[sides["<"]][before] + at[sides[">"]][behind]

    for r in range(1, rounds + 1):  # Adam on the penalised log-likelihood
        p, changes = chains.marginals(potentials(), moves)
        g = np.zeros(len(names))
        by_type = np.bincount(types, y - p, len(words))
        np.add.at(g, pairs[:, 1], by_type[pairs[:, 0]])
        for prefix, other in (("<", before), (">", behind)):
            g[sides[prefix][near]] += np.bincount(other, y - p, len(words) + 1)[near]
        grads = [g / scale - 1e-3 * w, float(by_type.sum() / scale), (seen - changes) / scale - 1e-3 * moves]
        steps = []
        for i, grad in enumerate(grads):
            speed[i] = 0.8 * speed[i] + 0.2 * grad
            square[i] = 0.95 * square[i] + 0.05 * grad**2
            steps.append(0.3 * (speed[i] / (1 - 0.8**r)) / (np.sqrt(square[i] / (1 - 0.95**r)) + 1e-8))
        w, bias, moves = w + steps[0], min(bias + steps[1], -3.0), moves + steps[2]
    model = Model({f: float(x) for f, x in zip(names, w, strict=True)}, float(bias), moves, np.zeros(3))
    p, _ = chains.marginals(potentials(), moves)
    model.document = _logistic(document_features(p, offs), label)
    return model


def document_features(p: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Constant, logit of the largest marginal (-6 to 6), log of one plus the expected toxic tokens among likely ones."""
    n = len(offs) - 1
    top, sure = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        top[full] = np.maximum.reduceat(p, offs[full])
        sure[full] = np.add.reduceat(np.where(p > 0.3, p, 0), offs[full])
    top = np.clip(top, 0.0025, 0.9975)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(sure)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - penalty * w)
    return w


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model

    def potentials(self, words: list[str], types: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Of each token, from its word and those beside it; types: places in words."""
        get, bias = self.model.weights.get, self.model.bias
        own, left, right = [], [], []
        for raw in words:
            w = raw.strip(_ENDS)
            own.append(bias + get("4:" + w[:4], 0.0) + get("5:" + w[:5], 0.0) + get("=" + w, 0.0))
            left.append(get("<" + w, 0.0))
            right.append(get(">" + w, 0.0))
        before, behind = neighbours_of(types, offs, len(words))
        return np.array(own)[types] + np.array([*left, 0.0])[before] + np.array([*right, 0.0])[behind]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Score, number of tokens that are toxic rather than not, and their places (start:end in characters) of each text."""
        coded, offs = tokens_of(texts)
        if len(coded):
            potential = self.potentials(coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offs)
            p, _ = Chains(offs).marginals(potential, self.model.moves)
        else:
            p = np.zeros(0)
        score = 1 / (1 + np.exp(-document_features(p, offs) @ self.model.document))
        hits = np.flatnonzero(p >= 0.5)
        doc = np.searchsorted(offs, hits, "right") - 1
        spans = [""] * len(texts)
        for d in np.unique(doc).tolist():
            spans[d] = ",".join(_places(texts[d].as_py(), (hits[doc == d] - offs[d]).tolist()))
        return score, np.bincount(doc, minlength=len(texts)), spans


def _places(text: str, numbers: list[int]) -> list[str]:
    """start:end of the tokens with these numbers."""
    out, at, wanted = [], 0, set(numbers)
    for k, token in enumerate(text.split()):
        at = text.index(token, at)
        if k in wanted:
            lead = len(token) - len(token.lstrip(_ENDS))
            body = clean(token) or token
            out.append(f"{at + lead if clean(token) else at}:{at + (lead if clean(token) else 0) + len(body)}")
        at += len(token)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, sample_bytes: int = SAMPLE_BYTES, stretch: int = STRETCH) -> Model:
    """Train on about sample_bytes of toxic documents and CLEAN times as much of other labelled ones, chosen by a hash.

    Documents of any length are learnt from; of a text beyond `stretch` characters a stretch of that length counts.
    """
    size, hashed = F.length("text"), F.xxhash64("doc_id", "text")
    at = F.when(size > stretch, F.pmod(F.xxhash64("text", F.lit(7)), F.greatest(size - stretch, F.lit(1)))).otherwise(0)
    fine = docs.where("text IS NOT NULL").select("doc_id", F.substring("text", (at + 1).cast("int"), F.lit(stretch)).alias("text"), hashed.alias("h"))
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic")
    sizes = known.join(fine.select("doc_id", F.octet_length("text").alias("size")), "doc_id").groupBy("toxic").agg(F.sum("size").alias("size"))
    total = {r.toxic: r["size"] for r in sizes.collect()}
    bound = lambda y, most: min((1 << 63) - 1, int((2 * min(1.0, most / max(1, total.get(y) or 0)) - 1) * (1 << 63)))  # noqa: E731  of a hash over 64 bits
    toxic, clean_ = bound(1, sample_bytes), bound(0, CLEAN * sample_bytes)
    some = known.join(fine.where(F.col("h") <= max(toxic, clean_)), "doc_id").where(F.col("h") <= F.when(F.col("toxic") == 1, toxic).otherwise(clean_))
    made = some.select("text", "toxic", "h").repartition(1).mapInArrow(tidied(_learn), "model binary").collect()  # about (1 + CLEAN) * sample_bytes meet in a task
    return pickle.loads(made[0].model) if made else train([])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the model learnt from all rows (text, toxic, h), in the same order every time."""
    rows = [r for b in batches for r in b.to_pylist()]
    model = train([(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["h"], r["toxic"], r["text"]))])
    del rows
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with score, toxic_tokens and spans (of the text; start:end, comma-joined)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for part in text_slices(batches, "text"):
            got = score(part.column(part.schema.get_field_index("text")))
            columns = [part.column(part.schema.get_field_index(c)) for c in keep] + [pa.array(got[0], pa.float64()), pa.array(got[1].astype(np.int64)), pa.array(got[2], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *(x.split()[0] for x in SCORES.split(", "))])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [SCORES])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(tidied(run), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs, table(spark, sf_dir, "labels").where(third != 1))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_tokens", "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; rows move nowhere."""
    return scored_in_place(docs, fit(docs, labels)).where(F.col("_score") < threshold).drop("_score")


def scored_in_place(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, with _score."""
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for part in text_slices(batches, "text"):
            got = score(part.column(part.schema.get_field_index("text")))[0]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], [*names, "_score"])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + ["_score double"])
    return docs.mapInArrow(tidied(run), schema)
