"""Quality rules in SQL functions: counts within a text, and line frequency across the documents of a host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

#: A line that more documents of one host than this have is removed from all but the first of them.
LINE_DOCS = 20
#: A document is depleted when less than this share of its words, or fewer words than MIN_WORDS, is left.
LEFT_SHARE = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50


def _source(docs: DataFrame) -> F.Column:
    return F.coalesce(docs["source"].cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), _source(docs).alias("host"), text.alias("text"))


#: Normalised lines of the column text: lower case, runs of white space one space, runs of digits one 0.
_LINES = r"split(regexp_replace(lower(regexp_replace(text, '[ \\t\\x0B\\f\\r]{2,}|[\\t\\x0B\\f\\r]', ' ')), '[0-9]+', '0'), '\n')"
_KEYED = f"transform({_LINES}, (l, i) -> struct(i as pos, if(trim(l) = '', null, xxhash64(host, trim(l))) as key, cast(length(trim(l)) - length(replace(trim(l), ' ', '')) + 1 as int) as words))"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, the counts within each text, and lines (pos from 0, key, words of each line that has a word).

    The counts are n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A null text has no words. The hash of
    a 3-word window, and of a host's normalised line, stands for it. Texts are read once: the result is written, so
    that no filter on a count is pushed down with the expressions of all of them.
    """
    words = _rows(docs).select(
        "doc_id",
        F.expr("xxhash64(host, text)").alias("text_key"),
        F.expr(r"filter(split(text, '\\s+'), x -> x <> '')").alias("w"),
        F.expr("cast(length(regexp_replace(text, '[^#*$%&|<>]+', '')) as long)").alias("n_symbols"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '\\S')").alias("texts"),
        F.expr(f"filter({_KEYED}, y -> y.key is not null)").alias("lines"),
    )
    windows = words.select(
        "doc_id", "text_key", "n_symbols", "lines",
        F.expr("cast(size(w) as long)").alias("n_words"),
        F.expr("cast(length(array_join(w, '')) as long)").alias("word_chars"),
        F.expr("cast(size(texts) - size(array_distinct(texts)) as long)").alias("n_dup_lines"),
        F.expr("if(size(w) < 3, array(), transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])))").alias("h"),
    )
    # Windows sorted by hash: a window is repeated where a neighbour has the same. Most texts have none.
    order = windows.withColumn("s", F.expr("if(size(h) = size(array_distinct(h)), null, sort_array(transform(h, (x, i) -> struct(x as x, i as i))))"))
    again = order.withColumn("p", F.expr("sort_array(filter(transform(s, (y, k) -> if(y.x <=> get(s, k - 1).x or y.x <=> get(s, k + 1).x, y.i, null)), z -> z is not null))"))
    # A repeated window covers three words, less what the next one covers again.
    covered = F.expr("coalesce(aggregate(transform(p, (a, k) -> least(3, coalesce(get(p, k + 1) - a, 3))), 0L, (t, c) -> t + c), 0L)")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    return written(again.select("doc_id", "text_key", *counts, covered.alias("n_repeat_words"), "lines"), "counts")


def removed_lines(rows: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """doc_id, text_key, pos, words of each line that goes from a document; `rows` is measured(). Repeated rows give each once.

    Those are the lines that over line_docs different documents of a host have, in all but the document of the
    smallest doc_id. The rows that have a line, counted first with partial sums, are at least as many as its
    documents; only lines with over line_docs rows are then counted by document.
    """
    lines = rows.select("doc_id", "text_key", F.explode("lines").alias("y")).select("doc_id", "text_key", "y.key", "y.pos", "y.words")
    common = written(lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > line_docs).select("key"), "lines")
    held = lines.join(common, "key")
    # Two steps: the first is dealt out by line and document, so a line that a third of all documents have is spread.
    frequent = held.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > line_docs).select("key", "first_doc")
    return held.join(written(frequent, "lines"), "key").where(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("doc_id", "text_key", "pos", "words").distinct()


def _failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def _depleted(lines: F.Column, words: F.Column) -> F.Column:
    left = F.col("n_words") - words
    return (lines > 0) & ((left < MIN_WORDS) | (left < LEFT_SHARE * F.col("n_words")))


def verdicts(docs: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, n_removed_words, n_removed_lines, base_failed, kept.

    kept is false where the base rules fail, and where lines were removed and the text is depleted. Lines are
    counted by different doc_ids: rows that repeat a doc_id are one document, rows without one are none (but lose
    frequent lines). Needs doc_id and text; without source all rows are of one host, as are null sources. A null
    or empty text fails the base rules; an empty table has no rows; other columns aren't read.
    """
    rows = measured(docs)
    removed = removed_lines(rows, line_docs).groupBy("doc_id", "text_key").agg(F.sum("words").cast("long").alias("n_removed_words"), F.count("*").alias("n_removed_lines"))
    base = rows.drop("lines")
    same = base["doc_id"].eqNullSafe(removed["doc_id"]) & (base["text_key"] == removed["text_key"])
    joined = base.join(removed, same, "left").select(base["*"], *(F.coalesce(removed[c], F.lit(0)).cast("long").alias(c) for c in ("n_removed_words", "n_removed_lines")))
    judged = joined.withColumn("base_failed", _failed())
    return judged.withColumn("kept", ~F.col("base_failed") & ~_depleted(F.col("n_removed_lines"), F.col("n_removed_words"))).drop("text_key")


def apply_rules(docs: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """The kept rows of docs, with their frequent lines taken out of text; all columns stay.

    A column n_chars is set anew where lines were taken out. Rows without text are never kept; else as in verdicts.
    """
    rows = measured(docs)
    lines = removed_lines(rows, line_docs).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("__mr_gone"), F.sum("words").cast("long").alias("__mr_words"))
    base = rows.select("doc_id", "text_key", "n_words", "n_repeat_words").distinct()
    judged = base.join(lines, base["doc_id"].eqNullSafe(lines["doc_id"]) & (base["text_key"] == lines["text_key"]), "left").select(base["*"], "__mr_gone", F.coalesce("__mr_words", F.lit(0)).alias("__mr_words"))
    good = judged.where(~_failed() & ~_depleted(F.coalesce(F.size("__mr_gone"), F.lit(0)), F.col("__mr_words"))).select(F.col("doc_id").alias("__mr_doc"), F.col("text_key").alias("__mr_text_key"), "__mr_gone")
    marked = docs.withColumn("__mr_key", F.xxhash64(_source(docs), F.coalesce(docs["text"].cast("string"), F.lit(""))))
    joined = marked.join(good, marked["doc_id"].cast("long").eqNullSafe(good["__mr_doc"]) & (marked["__mr_key"] == good["__mr_text_key"]))
    text = F.expr(r"if(__mr_gone is null, text, array_join(filter(split(text, '\n'), (l, i) -> not array_contains(__mr_gone, i)), '\n'))")
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__mr_gone").isNull(), F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(*(out[c].alias(c) if c in out else marked[c] for c in docs.columns))


#: The result of verdicts() over the table documents, for DuckDB; `i` tells rows apart that repeat a doc_id.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT i, doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT i, doc_id, w, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines FROM w),
g AS (SELECT i, unnest(range(1, n_words - 1)) AS k, w FROM c WHERE n_words >= 3),
t AS (SELECT i, k, count(*) OVER (PARTITION BY i, w[k], w[k + 1], w[k + 2]) AS n FROM g),
r AS (SELECT i, count(DISTINCT p) AS n_repeat_words FROM (SELECT i, unnest([k, k + 1, k + 2]) AS p FROM t WHERE n > 1) GROUP BY i),
n AS (SELECT i, doc_id, host, trim(unnest(string_split(regexp_replace(regexp_replace(lower(text), '[ \t\x0B\f\r]+', ' ', 'g'), '[0-9]+', '0', 'g'), chr(10))), ' ') AS l FROM d),
m AS (SELECT i, doc_id, host, l, length(l) - length(replace(l, ' ', '')) + 1 AS words FROM n),
f AS (SELECT host, l, min(doc_id) AS first_doc FROM m WHERE l <> '' GROUP BY host, l HAVING count(DISTINCT doc_id) > 20),
x AS (SELECT i, sum(words) AS n_removed_words, count(*) AS n_removed_lines FROM m JOIN f USING (host, l) WHERE doc_id IS DISTINCT FROM first_doc GROUP BY i),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_removed_words, 0) AS n_removed_words, coalesce(n_removed_lines, 0) AS n_removed_lines FROM c LEFT JOIN r USING (i) LEFT JOIN x USING (i)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_removed_words::BIGINT AS n_removed_words, n_removed_lines::BIGINT AS n_removed_lines, base_failed,
  NOT base_failed AND NOT (n_removed_lines > 0 AND (n_words - n_removed_words < 50 OR n_words - n_removed_words < 0.5 * n_words)) AS kept FROM b
"""
