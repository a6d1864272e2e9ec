"""Line dedup: winnowed line fingerprints, joined positions, matches extended both ways; later repeated runs go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, numbered, read, stored

#: A run of lines must have so many words to count as repeated.
WORDS = 10


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _words(line: Column) -> Column:
    """Blanks of the trimmed line, and one."""
    line = F.trim(line)
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _digest(line: Column) -> Column:
    """128 bits of SHA-256: lines with the same one are taken to be the same."""
    return F.substring(F.unhex(F.sha2(line.cast("binary"), 256)), 1, 16)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_row, doc_id, _mark, _matches: the winnowed lines of each row of `docs` (_row long, doc_id, text).

    A window is as few lines as have `words` words, from a line on or up to a line; lines without words are left aside.
    Of each window the line with the least digest is selected, and stands for all windows that select it: _matches has
    their first line, last line, and lines' digests. Since the selection depends on a window's lines alone, a run that
    is long enough to hold a window has the same line selected wherever it stands."""
    line = docs.select("_row", "doc_id", F.posexplode(F.transform(_lines(F.col("text")), lambda x: F.when(F.trim(x) != "", F.struct(_digest(x).alias("d"), _words(x).alias("n"))))).alias("_at", "_line"))
    line = line.where("_line is not null").select("_row", "doc_id", "_at", F.col("_line.d").alias("_d"), F.col("_line.n").alias("_n"))
    per = Window.partitionBy("_row").orderBy("_at")
    line = line.withColumn("_end", F.sum("_n").over(per)).withColumn("_begin", F.col("_end") - F.col("_n")).withColumn("_all", F.max("_end").over(Window.partitionBy("_row")))
    ahead = Window.partitionBy("_row").orderBy("_begin").rangeBetween(0, words - 1)
    behind = Window.partitionBy("_row").orderBy("_end").rangeBetween(-(words - 1), 0)

    def window(whole: Column, over, a: Column, z: Column) -> Column:
        least = F.min(F.struct(F.col("_d").alias("d"), F.col("_at").alias("m"))).over(over)
        return F.when(whole, F.struct(least.alias("s"), F.struct(a.alias("a"), z.alias("z"), F.collect_list("_d").over(over).alias("l")).alias("w")))

    seen = line.select(
        "_row", "doc_id",
        window(F.col("_all") - F.col("_begin") >= words, ahead, F.col("_at"), F.max("_at").over(ahead)).alias("_f"),
        window(F.col("_end") >= words, behind, F.min("_at").over(behind), F.col("_at")).alias("_g"),
    )
    both = seen.select("_row", "doc_id", F.explode(F.array("_f", "_g")).alias("_w")).where("_w is not null")
    # Rows of one document are together already: no exchange.
    return both.groupBy("_row", F.col("_w.s").alias("_s")).agg(F.first("doc_id").alias("doc_id"), F.collect_set("_w.w").alias("_matches")).select("_row", "doc_id", F.col("_s.d").alias("_mark"), "_matches")


def repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """_row, _lost array<int>: for each row of `docs` (_row long, doc_id, text) that has any, the 0-based numbers of
    the lines in later repeated runs, and of lines without words among them.

    A run is a stretch of lines of one document with `words` words or more, lines without any left aside. It is
    repeated if the same lines stand in the same order earlier: in a document with a smaller (doc_id, _row), nulls
    last, or further up. Steps, all on rows of numbers and digests:

    * Window minima are selected as fingerprints (see fingerprints).
    * Positions are joined: fingerprints whose line is selected nowhere else go. Their number is counted before it is
      exchanged, and a hot line's positions join one row.
    * Extension: from each position left, the lines on both sides are compared, by all their digests in order, as far as
      each window reaches. A window that stands earlier, too, is a match. Windows overlap along a run, so that its
      matches chain to both of its ends, whichever earlier documents it is repeated from. Each is compared to the first
      position with the same lines, never to each other one: a line repeated a million times takes a million
      comparisons, not their square."""
    marks = stored(fingerprints(docs, words))
    common = marks.groupBy("_mark").agg(F.count("*").alias("_times")).where("_times > 1").select(apart(F.col("_mark")).alias("_key"), F.col("_mark").alias("_m"))
    joined = marks.withColumn("_own", apart(F.col("_mark"))).join(common.hint("merge"), (F.col("_own") == F.col("_key")) & (F.col("_mark") == F.col("_m")))
    order = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("_row").alias("r"), F.col("_w.a").alias("a"))
    window = stored(joined.select("_row", "doc_id", F.explode("_matches").alias("_w")).select("_row", order.alias("_order"), F.col("_w.z").alias("_z"), F.col("_w.l").alias("_l")))
    first = window.groupBy("_l").agg(F.min("_order").alias("_first"), F.max("_order").alias("_last")).where("_first < _last").select(apart(F.col("_l")).alias("_key"), F.col("_l").alias("_k"), "_first")
    later = window.withColumn("_own", apart(F.col("_l"))).join(first.hint("merge"), (F.col("_own") == F.col("_key")) & (F.col("_l") == F.col("_k"))).where("_order > _first")
    return later.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("_order.a", "_z"))))).alias("_lost"))


def deduplicated(docs: DataFrame, words: int = WORDS, lost: str = "lines_lost") -> DataFrame:
    """`docs`, with the lines of later repeated runs taken from `text` (see repeated_lines), and a column that says how
    many; a column of docs with that name gives way. Other columns stay as they are, whatever they are called; so does
    a null or empty text, and one that loses nothing. A text that loses all its lines is empty. Lines without words
    that stood between lost ones stay. Of equal rows, all but one are later. An empty table gives an empty table."""
    own = numbered(docs)
    gone = stored(repeated_lines(own.select("_row", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text")), words)).withColumnRenamed("_row", "_own")
    # The plan for large tables, whatever the size: what is lost grows with the documents and isn't broadcast.
    joined = own.join(gone.hint("merge"), F.col("_row") == F.col("_own"), "left")
    # Columns of their own, so that a text is split once.
    joined = joined.withColumn("_lines", F.when(F.col("_lost").isNotNull(), _lines(F.col("_doc.text"))))
    joined = joined.withColumn("_gone", F.filter("_lost", lambda k: F.trim(F.get("_lines", k)) != ""))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("_doc.text")).otherwise(F.array_join(F.transform(kept, lambda k: F.get("_lines", k)), "\n"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns if c != lost], F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias(lost))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "lines_lost", "text")


#: The same by windows over exploded lines. Lines without words stay, as in the query.
SQL = f"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
l AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM d),
n AS (SELECT *, length(trim(line, ' ')) - length(replace(trim(line, ' '), ' ', '')) + 1 AS n FROM l WHERE trim(line, ' ') <> ''),
s AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY pos)::BIGINT AS e, sum(n) OVER (PARTITION BY r)::BIGINT AS total FROM n),
t AS (SELECT *, e - n AS b FROM s),
w AS (SELECT r, pos AS a, max(pos) OVER f AS z, list(line) OVER f AS c, total - b >= {WORDS} AS whole FROM t
      WINDOW f AS (PARTITION BY r ORDER BY b RANGE BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING)
      UNION ALL
      SELECT r, min(pos) OVER g, pos, list(line) OVER g, e >= {WORDS} FROM t
      WINDOW g AS (PARTITION BY r ORDER BY e RANGE BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW)),
q AS (SELECT r, a, z, min((r, a)) OVER (PARTITION BY c) AS f FROM w WHERE whole),
x AS (SELECT DISTINCT r, unnest(range(a, z + 1)) AS pos FROM q WHERE (r, a) > f),
y AS (SELECT l.r, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE n.r IS NULL OR x.r IS NULL) AS text, count(*) FILTER (WHERE x.r IS NOT NULL AND n.r IS NOT NULL) AS lost
      FROM l LEFT JOIN x ON l.r = x.r AND l.pos = x.pos LEFT JOIN n ON l.r = n.r AND l.pos = n.pos GROUP BY l.r)
SELECT d.doc_id, y.lost::BIGINT AS lines_lost, CASE WHEN y.lost = 0 THEN d.text ELSE coalesce(y.text, '') END AS text FROM d JOIN y USING (r)
"""
