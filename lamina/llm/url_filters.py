"""URL filters: host-suffix and path-prefix expressions, looked up by short hash prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of query op2 (fixed values).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1))
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    cut = F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1)
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (F.instr(cut, "/") > 0), cut.substr(F.instr(cut, "/"), F.length(cut))), F.lit(""))


def _after(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def _folder(path: Column) -> Column:
    """The path up to its last slash, that one included."""
    return F.coalesce(F.regexp_extract(path, "^(?s:.*/)", 0), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def filtered(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages` (page_id, url). rules: host, path, verdict.

    A rule fits its host and all subdomains, if the url's path starts with the rule's; the longest rule string wins,
    then the longer host, then `block` before `allow`. No rule: null, and `default`. A null url, and one without
    `://`, has empty host and path. Rules with null host, path or verdict are left out, equal ones count once. Rows of
    `pages` that are equal stay apart.

    Each url is expanded into its host's suffixes and its path's folders, as far as any rule is deep; a rule is filed
    under its own host and folder. The two meet in an equi-join on the first `prefix` hex digits of the expression's
    SHA-256; full digests and the rule's whole path are compared then. Spark broadcasts the rules if it knows them to
    be small, and sorts and splits by key otherwise. The only other exchange is of one row for each page, since rows
    of one page are combined where they are made. The rules are stored first, which tells their size. The order of rows in `pages` must be the same each time it is read,
    as it is for files."""
    rules = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v")).where("_h is not null and _p is not null and _v is not null").distinct()
    rules = rules.select("*", F.sha2(F.concat("_h", F.lit("\n"), _folder(F.col("_p"))), 256).alias("_digest"))
    rules = stored(rules.select("_h", "_p", "_v", "_digest", F.substring("_digest", 1, prefix).alias("_key")))
    deepest = rules.agg(F.max(F.size(F.split("_h", r"\."))), F.max(F.size(F.split(_folder(F.col("_p")), "/")))).first()
    labels, folders = deepest[0] or 0, deepest[1] or 0
    url = pages.select(F.monotonically_increasing_id().alias("_row"), F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts, steps = F.split("host", r"\."), F.split(_folder(F.col("path")), "/")
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), ".")) if labels else F.array().cast("array<string>")
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(steps), F.lit(folders))), lambda k: F.when(k == 1, "").otherwise(F.concat(F.array_join(F.slice(steps, 1, k - 1), "/"), F.lit("/")))) if folders else F.array().cast("array<string>")
    digests = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256))))
    expressions = url.select("*", F.explode_outer(digests).alias("_e")).withColumn("_short", F.substring("_e", 1, prefix))
    fits = (F.col("_short") == F.col("_key")) & (F.col("_e") == F.col("_digest")) & F.startswith(F.col("path"), F.col("_p"))
    string = F.concat("_h", "_p")
    rank = F.struct(F.length(string), F.length("_h"), F.when(F.col("_v") == "block", 1).otherwise(0), string.alias("rule"), F.col("_v").alias("verdict"))
    best = expressions.join(rules, fits, "left").groupBy("_row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("_v").isNotNull(), rank)).alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(read(spark, sf_dir, "pages").select("page_id", "url"), rules_table(spark))


_REST = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
SQL = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract({_REST}, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
                  coalesce(regexp_extract({_REST}, '^[^/?#]*(/[^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
r(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
m AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (n)
"""
