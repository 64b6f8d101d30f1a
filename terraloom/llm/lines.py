"""Removal of repeated passages: overlapping windows of three lines, the same anywhere, once.

Each document's lines (between newlines, without spaces at their ends) are hashed; a window is three neighbouring
lines that are not all blank. Of equal windows the first one, by (doc_id, text's hash, line) with rows without an id
last, stays; the lines that the others cover are removed, but for lines of a first one, so that a whole copy of every
passage is left. Windows travel as two 64-bit hashes with a row's name and a line number, the text does not;
occurrences are counted where they are read, before any shuffle, and a window that holds a large share of all rows is
dealt to many tasks.

Null texts have no lines and stay null. A row is known by its id and text: rows without an id or with one id take
part by their texts, and rows equal in both count as one occurrence and keep or lose the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import let, spread_join, staged, table

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, line, h, g) of every window."""
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.trim(x))

    def hashes(lines: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(lines) - WINDOW),
            lambda i: F.when(
                (F.get(lines, i) != "") | (F.get(lines, i + 1) != "") | (F.get(lines, i + 2) != ""),
                F.struct(i.cast("int").alias("line"), F.xxhash64(F.get(lines, i), F.get(lines, i + 1), F.get(lines, i + 2)).alias("h"), F.xxhash64(F.lit("g"), F.get(lines, i + 2), F.get(lines, i), F.get(lines, i + 1)).alias("g")),
            ),
        )

    rows = docs.where(F.col("text").isNotNull() & (F.size(F.split("text", "\n", -1)) >= WINDOW))
    found = rows.select("doc_id", F.xxhash64("text", "doc_id").alias("key"), F.explode(let(trimmed, hashes)).alias("w")).where("w IS NOT NULL")
    return found.select("doc_id", "key", "w.line", "w.h", "w.g")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, removed): the numbers, from 0, of the lines that later occurrences of windows cover and no first one."""
    windows = _windows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key", "line")
    repeated = staged(windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"))
    found = spread_join(windows, repeated.drop("n"), ["h", "g"], repeated.select("h", "g", "n"))
    is_first = place == F.col("first")
    cover = lambda lines: F.flatten(F.transform(lines, lambda i: F.array(i, i + 1, i + 2)))
    per = found.groupBy("doc_id", "key").agg(F.collect_set(F.when(~is_first, F.col("line"))).alias("later"), F.collect_set(F.when(is_first, F.col("line"))).alias("firsts"))
    return per.select("doc_id", "key", F.array_except(cover("later"), cover("firsts")).alias("removed")).where(F.size("removed") > 0)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(row, text, lines, removed): a row of docs whole, its text without repeated passages, the numbers of its lines and of those removed."""
    gone = repeated_lines(docs.select("doc_id", "text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text", "doc_id").alias("name"))
    out = rows.join(gone, (F.col("name") == F.col("key")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id")), "left")
    lines = F.split("row.text", "\n", -1)
    kept = lambda own: F.array_join(F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("removed"))), lambda i: F.get(own, i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(let(lines, kept))
    counted = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines))
    return out.select("row", text.alias("text"), counted.cast("long").alias("lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "text", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"))


def pruned(docs: DataFrame) -> DataFrame:
    """docs, all columns, with repeated passages removed; documents of which nothing is left go."""
    found = without_repeats(docs).where((F.col("removed") == 0) | (F.trim("text") != ""))
    return found.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p - 1 AS line, trim(l[p], ' ') || chr(10) || trim(l[p + 1], ' ') || chr(10) || trim(l[p + 2], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM d WHERE len(l) >= 3)),
ranked AS (SELECT doc_id, line, g, row_number() OVER (PARTITION BY g ORDER BY doc_id, line) AS k FROM w WHERE g <> chr(10) || chr(10)),
often AS (SELECT g FROM ranked GROUP BY g HAVING count(*) > 1),
firsts AS (SELECT DISTINCT doc_id, unnest([line, line + 1, line + 2]) AS line FROM ranked JOIN often USING (g) WHERE k = 1),
later AS (SELECT DISTINCT doc_id, unnest([line, line + 1, line + 2]) AS line FROM ranked WHERE k > 1),
gone AS (SELECT doc_id, line FROM later EXCEPT SELECT doc_id, line FROM firsts),
kept AS (SELECT d.doc_id, string_agg(l[p], chr(10) ORDER BY p) FILTER (WHERE g.line IS NULL) AS text, count(*) AS n_lines, count(g.line) AS n_removed
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d) d LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.p - 1 = g.line GROUP BY d.doc_id)
SELECT o.doc_id, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents o LEFT JOIN kept k ON o.doc_id = k.doc_id
"""
