"""Personal data in texts: fixed patterns, and further spans from weak supervision.

Words, and parts of words between punctuation, with a digit or an at sign are candidates. Labelers vote on each (for, against, or not at all): patterns,
gazetteers of mail domains and calling codes, the word before it, two that know what is harmless, and the check digit
of long numbers. Expectation maximisation over the counts of vote combinations estimates how reliable each labeler is,
without labels, but for one thing: a vote for is held to speak for, and one against to speak against. The
combinations' posteriors then train a logistic classifier on a candidate's shape, on the votes and on whether the word
before it is a telling one; it decides and also reaches candidates on which no labeler votes. All of it is DataFrame functions; what comes to the driver are
counts of combinations, of which there are a few thousand at most, whatever the input.

Null texts are empty; rows with equal or null ids are judged each for itself.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import let, table
from terraloom.llm.spans import apart, joined, labelled, spans

SURE = 0.9
LEAST_ODDS = 1.0  # log-odds that a vote carries at least
# fixed values: the patterns of the contract; a lookbehind and possessive runs keep long texts linear
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# candidates end at white space, quotes, brackets, separators and characters of scripts without spaces
BREAKS = r"\s\"'`,;<>{}\[\]|=&?!\\/:\u0e00-\u0e7f\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\x{20000}-\x{3ffff}"  # ranges: faster than names of scripts
CANDIDATE = rf"(?<![^{BREAKS}])[^{BREAKS}0-9@]*+[0-9@][^{BREAKS}]*+"
MAIL_WORDS = "mail|example|inbox|post|gmx|outlook|yahoo|proton"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = r"^(?:e-?mail|mail|phone|tel|mobile|cell|call|fax|contact|card|visa|account|iban|address|ip|host|id|ssn|passport|from|to|by)[.:,]?$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans, labelled."""
    only = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    between = lambda x, low, high: F.length(only(x)).between(low, high)
    ip = F.filter(spans(text, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), lambda x: x["value"].rlike(IP_PARTS))
    card = F.filter(spans(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda x: F.when(between(x, 12, 19), luhn(only(x))).otherwise(False))
    phone = F.filter(spans(text, PHONE, text.contains("+")), lambda x: between(x, 9, 15))
    return F.concat(labelled(spans(text, EMAIL, text.contains("@")), "email", 0), labelled(ip, "ip", 1), labelled(card, "card", 2), labelled(phone, "phone", 3))


def candidates(text: Column) -> Column:
    """Spans of candidate words with the word before each."""
    found = spans(text, CANDIDATE, text.rlike("[0-9@]"))
    before = lambda x: F.lower(F.regexp_extract(x["lead"], rf"([^{BREAKS}]+)[{BREAKS}]*$", 1))  # noqa: E731  of the text behind the candidate before
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), before(x).alias("before")))


def votes(value: Column, before: Column) -> list[Column]:
    """1 for, 2 against, 0 none, by labeler."""
    plain = F.regexp_replace(value, r"^[(\"'<\[]+|[)\"'>\].,;:!?]+$", "")
    yes = lambda c: F.when(c, 1).otherwise(0)
    no = lambda c: F.when(c, 2).otherwise(0)
    return [
        yes(plain.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+$|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^\+?[0-9][0-9().-]{8,24}$")),
        yes(F.lower(plain).rlike(rf"@.*(?:{MAIL_WORDS})|\.(?:com|org|net|edu|de|fr|es)$") | plain.rlike(CALLING)),
        yes(before.rlike(CONTEXT)),
        no(plain.rlike(r"^[0-9]{1,4}(?:[.,][0-9]{1,2})?%?$|^[0-9]{1,2}(?:st|nd|rd|th)$|^(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}$")),
        no(plain.rlike(r"[=/_\\{}<>|]|(?=[0-9]*[a-f])[0-9a-f]{16}|[A-Z][0-9][A-Z]")),
        F.when(plain.rlike(r"^[0-9](?:[\x20-]?[0-9]){11,18}$"), F.when(luhn(F.regexp_replace(plain, "[^0-9]", "")), 1).otherwise(2)).otherwise(0),
    ]


def shape(value: Column) -> list[Column]:
    """Buckets of what a candidate looks like."""
    digits, size = F.length(F.regexp_replace(value, "[^0-9]", "")), F.length(value)
    dots = F.length(F.regexp_replace(value, r"[^.]", ""))
    return [
        F.when(digits >= 12, 5).when(digits >= 9, 4).when(digits >= 5, 3).when(digits >= 3, 2).when(digits >= 1, 1).otherwise(0),
        F.when(value.contains("@"), 1).otherwise(0),
        F.least(dots, F.lit(4)),
        F.when(value.rlike(r"[A-Za-z]{2}"), 1).otherwise(0),
        F.when(size >= 24, 4).when(size >= 16, 3).when(size >= 10, 2).when(size >= 5, 1).otherwise(0),
        F.when(value.rlike("[A-Za-z][0-9]+[A-Za-z]") & ~value.contains("@"), 1).otherwise(0),
        F.when(value.startswith("+"), 2).when(value.rlike("[-()]"), 1).otherwise(0),
        F.when(value.rlike("^[0-9]+$"), 2).when(value.rlike("^[0-9a-f]{16,}$"), 1).otherwise(0),
    ]


def features(value: Column, before: Column) -> list[Column]:
    """What the classifier sees: shape, and votes, the third of which is on the word before."""
    return [*shape(value), *votes(value, before)]


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """P(personal) of each vote combination by expectation maximisation, started from the majority of votes."""
    rows = list(counts)
    if not rows:
        return {}
    v, n = np.array(rows), np.array([counts[r] for r in rows], float)
    lead = (v == 1).sum(1) - (v == 2).sum(1)
    p = np.where(lead > 0, 0.9, np.where(lead < 0, 0.05, 0.3))
    for _ in range(rounds):
        w1, w0 = n * p, n * (1 - p)
        prior = (w1.sum() + 1) / (n.sum() + 2)
        log = np.full(len(rows), np.log(prior / (1 - prior)))
        for j in range(v.shape[1]):
            for vote in (0, 1, 2):
                at = v[:, j] == vote
                if at.any():
                    odds = np.log((w1[at].sum() + 0.5) / (w1.sum() + 1.5)) - np.log((w0[at].sum() + 0.5) / (w0.sum() + 1.5))
                    log[at] += max(odds, LEAST_ODDS) if vote == 1 else min(odds, -LEAST_ODDS) if vote == 2 else odds
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return dict(zip(rows, p.tolist(), strict=True))


def classifier(shapes: list[tuple[int, ...]], target: np.ndarray, weight: np.ndarray) -> list[dict[int, float]]:
    """A weight for each bucket of each part of a shape (the last dict holds the constant), by Newton's method."""
    names = sorted({(j, x) for s in shapes for j, x in enumerate(s)})
    index = {k: i + 1 for i, k in enumerate(names)}
    x = np.zeros((len(shapes), len(names) + 1))
    x[:, 0] = 1
    for r, s in enumerate(shapes):
        for j, value in enumerate(s):
            x[r, index[j, value]] = 1
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (target - p)) - w)
    parts: list[dict[int, float]] = [{} for _ in range(max([j for j, _ in names], default=-1) + 1)]
    for (j, value), i in index.items():
        parts[j][value] = float(w[i])
    return [*parts, {0: float(w[0])}]


def fit(docs: DataFrame) -> list[dict[int, float]]:
    """The classifier, from the votes and shapes of all documents' candidates."""
    some = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = some.select(F.explode(candidates(F.col("text"))).alias("c"))
    seen = found.select(F.array(*votes(F.col("c.value"), F.col("c.before"))).alias("v"), F.array(*features(F.col("c.value"), F.col("c.before"))).alias("s"))
    rows = seen.groupBy("v", "s").count().collect()  # one row for each combination of buckets at most
    if not rows:
        return []
    counts: dict[tuple[int, ...], int] = {}
    for r in rows:
        counts[tuple(r.v)] = counts.get(tuple(r.v), 0) + r["count"]
    posterior = reliabilities(counts)
    return classifier([tuple(r.s) for r in rows], np.array([posterior[tuple(r.v)] for r in rows]), np.array([r["count"] for r in rows], float))


def probability(value: Column, before: Column, model: list[dict[int, float]]) -> Column:
    log = F.lit(model[-1][0])
    for column, weights in zip(features(value, before), model[:-1], strict=True):
        log = log + F.coalesce(F.element_at(F.create_map(*map(F.lit, chain.from_iterable(weights.items()))), column), F.lit(0.0))
    return 1 / (1 + F.exp(-log))


def personal(docs: DataFrame, model: list[dict[int, float]], *, sure: float = SURE) -> DataFrame:
    """(doc_id, base, more): the fixed patterns' spans, and candidates beside them that the classifier is sure of (kind personal)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    if not model:
        return rows.select("doc_id", "base", F.filter("base", lambda _: F.lit(False)).alias("more"))
    found = F.filter(candidates(F.col("text")), lambda x: probability(x["value"], x["before"], model) >= sure)
    more = let(F.col("base"), lambda base: apart(labelled(found, "personal", 4), base))
    return rows.select("doc_id", "base", more.alias("more"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal(docs, fit(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
