"""Cross-document line frequency, in DataFrame functions only.

Every line that holds a word is normalised (ASCII lower case, white space runs to one blank,
trimmed) and hashed. For each host (column ``source``) the operator counts in how many distinct
documents a line occurs. Lines in more than ``min_docs`` documents and in more than ``share`` of the
host's (or in more than ``most_docs``, however large the host) are removed, and a document is rejected
if too little is left. Texts are read once: what follows works on the lines' hashes.

Defined results: null text counts as no text (no words, base_failed true); null hosts form one
host of their own; a document is a doc_id, and rows without one are told apart by their texts; rows of one
doc_id count once in a line's documents and get their own results, one row each; an empty table gives an
empty table; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS, materialize

SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineLimits:
    min_docs: int = 10  #: a line in at most so many documents of a host always stays
    share: float = 0.01  #: nor is it removed up to this share of the host's documents
    most_docs: int = 10_000  #: unless it is in more than these, so that no host is too large to be cleaned
    max_removed_pct: int = 60  #: a document that loses a larger share of its words is depleted
    min_left_words: int = 30  #: so is one with fewer words left


def _words(text: Column) -> Column:
    t = F.btrim(text, F.lit(WS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{WS_CLASS}+"))


def _line_structs(lines: Column) -> Column:
    """Of each line with a word: its hash when normalised, and its number of words."""
    norm = lambda x: F.translate(F.regexp_replace(F.btrim(x, F.lit(WS)), f"{WS_CLASS}+", " "), UPPER, LOWER)
    return F.transform(F.transform(lines, norm), lambda n: F.struct(F.xxhash64(n).alias("h"), (F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).alias("n")))


def _with_lines(docs: DataFrame) -> DataFrame:
    """rid (a number for each row), doc_id, did (the document), source, text, ls (its lines with a word)."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(text)).alias("did"), docs["doc_id"].isNull().alias("none"), F.coalesce(docs["source"].cast("string"), F.lit("\x00")).alias("source"), text.alias("text"))
    return d.withColumn("ls", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WS)) != ""))


def line_table(docs: DataFrame) -> DataFrame:
    """rid, doc_id, did, none, source, base columns and lines (h, n) of each row, written once.

    Repeated 3-word windows are found inside the row: windows are hashed (64 bits), sorted with
    their position, and neighbours in that order compared; nothing is shuffled.
    """
    d = _with_lines(docs).withColumn("w", _words(F.col("text")))
    d = d.select(
        "rid", "doc_id", "did", "none", "source",
        _line_structs(F.col("ls")).alias("lines"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))
        ).alias("s"),
    )
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("r", F.sort_array(F.transform(F.filter("s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("r", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("r", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return materialize(d.withColumn("n_repeat_words", covered.cast("long")).drop("s", "r"), "line_table")


def frequent_lines(rows: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """(source, h, docs) of the lines above the limits, from rows with source, none, did and lines. All
    aggregations combine before they shuffle, so a line or host that holds a third of all rows stays cheap."""
    hosts = rows.select("source", "none", "did").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = rows.select("source", "none", "did", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).distinct()
    counts = lines.groupBy("source", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > limits.min_docs)
    over = F.col("docs") > F.least(F.col("host_docs") * limits.share, F.lit(limits.most_docs))
    # written, so that the joins with it may split a line that very many documents have
    return materialize(counts.join(hosts, "source").where(over).select("source", "h", "docs"), "frequent_lines")


def line_frequency(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """One row per document: base columns, n_frequent_lines, n_removed_words, base_failed, kept."""
    rows = line_table(docs)
    frequent = frequent_lines(rows, limits)
    lines = rows.select("rid", "source", F.explode("lines").alias("x")).select("rid", "source", "x.h", "x.n")
    removed = lines.join(frequent.select("source", "h"), ["source", "h"], "left_semi").groupBy("rid").agg(F.sum("n").alias("rn"), F.count(F.lit(1)).alias("rc"))
    out = rows.drop("lines").join(removed, "rid", "left")
    n, gone = F.col("n_words"), F.coalesce(F.col("rn"), F.lit(0))
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    depleted = (100 * gone > limits.max_removed_pct * n) | (n - gone < limits.min_left_words)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce(F.col("rc"), F.lit(0)).cast("long").alias("n_frequent_lines"), gone.cast("long").alias("n_removed_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )


def cleaned_texts(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """doc_id and text without its frequent lines (all rows, rejected ones included)."""
    d = docs.select(F.expr("uuid()").alias("row"), "doc_id", F.coalesce(docs["source"].cast("string"), F.lit("\x00")).alias("source"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    d = materialize(d, "line_texts")  # a row keeps its number if it is read again
    lines = d.select("row", "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    lines = lines.withColumn("h", F.when(F.btrim("line", F.lit(WS)) != "", F.element_at(_line_structs(F.array("line")), 1)["h"]))
    marked = lines.join(frequent_lines(line_table(docs), limits).select("source", "h", F.lit(True).alias("gone")), ["source", "h"], "left").where(F.col("gone").isNull())
    kept = marked.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return d.select("row", "doc_id").join(kept, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS source, coalesce(text, '') AS text FROM documents),
f AS (
  SELECT doc_id, source, text,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d),
g AS (
  SELECT *, len(w) AS n_words,
    CASE WHEN len(w) < 3 THEN [] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END AS tri,
    list_transform(ls, lambda x: translate(regexp_replace(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ns
  FROM f),
t AS (SELECT doc_id, unnest(tri) AS tri, generate_subscripts(tri, 1) AS i FROM g),
t2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM t),
t3 AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM t2 WHERE c > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS n FROM t3 GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(ns) AS line FROM g),
hosts AS (SELECT source, count(DISTINCT coalesce(CAST(doc_id AS varchar), 'text ' || text)) AS host_docs FROM d GROUP BY source),
freq AS (
  SELECT l.source, l.line FROM lines l JOIN hosts h ON l.source = h.source GROUP BY l.source, l.line, h.host_docs
  HAVING count(DISTINCT coalesce(CAST(l.doc_id AS varchar), 'text ' || l.text)) > 10
    AND count(DISTINCT coalesce(CAST(l.doc_id AS varchar), 'text ' || l.text)) > least(h.host_docs * 0.01, 10000)),
gone AS (
  SELECT l.doc_id, count(*) AS c, sum(len(string_split(l.line, ' '))) AS n
  FROM lines l JOIN freq ON l.source = freq.source AND l.line = freq.line GROUP BY l.doc_id),
o AS (
  SELECT g.doc_id, CAST(n_words AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.c, 0) AS BIGINT) AS n_frequent_lines, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM g LEFT JOIN rep ON g.doc_id = rep.doc_id LEFT JOIN gone ON g.doc_id = gone.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
  AND NOT (100 * n_removed_words > 60 * n_words OR n_words - n_removed_words < 30) AS kept
FROM o
"""
