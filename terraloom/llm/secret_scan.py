"""Secrets in texts: fixed patterns, and words that read like random characters.

Two first-order Markov models of characters are learnt from all documents, one from values that the fixed patterns
found (random strings), one from the words outside them: prose, identifiers, numbers, paths. A word's log-likelihood
ratio per character decides, so a number, whose characters ordinary words hold as well, is no secret. Words are
counted before their characters are, so a text that many documents share costs one row. All of it is DataFrame
functions; the models are two tables of at most 67 x 67 transitions.

Null texts are empty; rows with equal or null ids are judged each for itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import let, staged, table
from terraloom.llm.spans import apart, joined, labelled, spans

LEAST_RATIO = 1.0  # per character
APART = 2.5  # for words of letters in one case
LEAN = 5.0  # weight of a character's own frequency in its transitions
# fixed values: the patterns of the contract
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)$"""
ASSIGN_AHEAD = r"(?i)(?:passw|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{32,}+"
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
ONE_CASE = r"^(?:[A-Z]?[a-z]++|[A-Z]++)$"  # scored in small letters, against a bound of their own
PAIR = r"^[A-Za-z0-9+/_=-]{2}$"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+"  # words that are learnt from
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _ahead(text: Column) -> Column:
    """A cheap condition that holds for every text with a match of a fixed pattern."""
    return _assigns(text) | text.contains("AKIA") | text.rlike("[0-9a-f]{32}")


def _assigns(text: Column) -> Column:
    return (text.contains("=") | text.contains(":")) & text.rlike(ASSIGN_AHEAD)


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans, labelled."""
    assign = F.filter(spans(text, ASSIGN, _assigns(text)), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN_VALUE, 1)) >= 8)
    access = F.filter(spans(text, ACCESS, text.contains("AKIA")), lambda x: F.length(x["value"]) >= 16)
    return F.concat(labelled(assign, "assign", 0), labelled(access, "access", 1), labelled(spans(text, HEX, text.rlike("[0-9a-f]{32}")), "hex", 2))


def samples(docs: DataFrame) -> DataFrame:
    """(value, random, n): the labelled words of all documents, and how often they occur."""
    some = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    value = lambda x: F.when(x["kind"] == "assign", F.regexp_extract(x["value"], ASSIGN_VALUE, 1)).otherwise(x["value"])
    found = some.select(F.explode(F.transform(base_spans(F.col("text")), value)).alias("value"), F.lit(True).alias("random"))
    rest = F.when(_ahead(F.col("text")), F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")).otherwise(F.col("text"))
    words = some.select(F.explode(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0))).alias("value"), F.lit(False).alias("random"))
    return found.union(words).groupBy("value", "random").agg(F.count("*").alias("n"))


def fit(labelled_words: DataFrame) -> dict[str, float]:
    """Log-likelihood ratio (random to ordinary) of each character pair; labelled_words: value, random and, if counted, n."""
    if "n" not in labelled_words.columns:
        labelled_words = labelled_words.withColumn("n", F.lit(1))
    pairs = labelled_words.select("random", "n", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("value") - 1, F.lit(1))), lambda i: F.substring(F.col("value"), i, F.lit(2)))).alias("pair"))
    rows = pairs.where(F.col("pair").rlike(PAIR)).groupBy("random", "pair").agg(F.sum("n").alias("count")).collect()  # at most two for each pair of the alphabet
    n: dict[tuple[bool, str], int] = {(r.random, r.pair): r["count"] for r in rows}
    total: dict[tuple[bool, str], int] = {}
    single: dict[tuple[bool, str], int] = {}
    for (kind, pair), count in n.items():
        total[kind, pair[0]] = total.get((kind, pair[0]), 0) + count
        single[kind, pair[1]] = single.get((kind, pair[1]), 0) + count
    if not any(kind for kind, _ in n):
        return {}
    every = {kind: sum(c for (k, _), c in single.items() if k == kind) for kind in (True, False)}

    def log(kind: bool, a: str, b: str) -> float:
        """A transition's probability; rare contexts lean on how frequent the character is."""
        alone = (single.get((kind, b), 0) + 1) / (every[kind] + len(ALPHABET))
        return math.log((n.get((kind, a + b), 0) + LEAN * alone) / (total.get((kind, a), 0) + LEAN))

    return {a + b: log(True, a, b) - log(False, a, b) for a in ALPHABET for b in ALPHABET}


def ratio(word: Column, model: dict[str, float]) -> Column:
    """Mean log-likelihood ratio of a word's transitions; the table is indexed by the characters' places."""
    size = len(ALPHABET)
    values = F.array(*[F.lit(float(model.get(a + b, 0.0))) for a in ALPHABET for b in ALPHABET])
    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def score(table_: Column) -> Column:
        zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
        step = lambda acc, c: F.struct(c.alias("last"), F.when((acc["last"] >= 0) & (c >= 0), acc["sum"] + F.get(table_, acc["last"] * size + c)).otherwise(acc["sum"]).alias("sum"))
        return F.aggregate(codes, zero, step, lambda acc: acc["sum"] / F.greatest(F.length(word) - 1, F.lit(1)))

    return score(values)


def one_case_bound(labelled_words: DataFrame, model: dict[str, float]) -> float:
    """The ratio above which a word of letters in one case is random, from ordinary such words of 16 letters or more.

    APART times as far above the median as the lowest hundredth lies below it: the lower half of the ratios has no
    random words, so those among the ordinary do not move the bound. It may be below 0, as the random model spreads
    over all characters.
    """
    if not model:
        return LEAST_RATIO
    words = labelled_words.where(~F.col("random") & (F.length("value") >= 16) & F.col("value").rlike(ONE_CASE))
    weight = F.col("n") if "n" in words.columns else F.lit(1)
    rows = words.select(F.round(ratio(F.lower("value"), model), 2).alias("r"), weight.alias("n")).groupBy("r").agg(F.sum("n").alias("count")).collect()  # some hundreds at most
    if not rows:
        return LEAST_RATIO
    found = sorted((r.r, r["count"]) for r in rows)
    total = sum(n for _, n in found)

    def quantile(share: float) -> float:
        seen = 0
        for r, n in found:
            seen += n
            if seen >= share * total:
                return r
        return found[-1][0]

    middle = quantile(0.5)
    return middle + APART * (middle - quantile(0.01))


def secrets(docs: DataFrame, model: dict[str, float], *, least: float = LEAST_RATIO, one_case: float = LEAST_RATIO) -> DataFrame:
    """(doc_id, base, more): the fixed patterns' spans, and words beside them that read as random (kind random).

    one_case: the least ratio of words of letters in one case.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    if not model:
        return rows.select("doc_id", "base", F.filter("base", lambda _: F.lit(False)).alias("more"))
    plain = lambda x: x["value"].rlike(ONE_CASE)
    reads_random = lambda x: ratio(F.when(plain(x), F.lower(x["value"])).otherwise(x["value"]), model) >= F.when(plain(x), one_case).otherwise(least)
    words = F.filter(spans(F.col("text"), WORD, F.col("text").rlike("[A-Za-z0-9+/_=-]{16}")), reads_random)
    more = let(F.col("base"), lambda base: apart(labelled(words, "random", 3), base))
    return rows.select("doc_id", "base", more.alias("more"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = staged(samples(docs))
    model = fit(words)
    found = secrets(docs, model, one_case=one_case_bound(words, model))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"))
