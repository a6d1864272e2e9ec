"""Quality classifier: a document's evidence and its site's, by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashed
from .common import label_share, labelled, prepared, read, slices, stored, tidy

#: Labelled rows of each class that the document classifier is fitted on, at most.
SAMPLE = 1200
#: A document is kept from this posterior probability of good quality on: one is rejected only if it is clearly poor.
THRESHOLD = 0.3


def evidence(model: hashed.Model) -> Column:
    """The document classifier's probability for column `text`; a null text counts as empty."""

    @F.arrow_udf("double")
    def judge(texts: pa.Array) -> pa.Array:
        own = pc.fill_null(texts, "")
        parts = [hashed.sigmoid(model.logits(own.slice(*x))) for x in slices(own)]
        tidy()
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return judge(F.col("text"))


@dataclass
class Sites:
    """What is known of sites. table: _host, _path, _n, _s (documents, and their probabilities' sum), _prior (the
    path's shrunken prior before its own evidence), _strength. mean: the global share of good documents."""

    table: DataFrame
    mean: float

    def posterior(self, p: Column) -> Column:
        """Of a document with classifier probability p, joined to its row of the table. The path's posterior mean is
        that of its other documents, so that a document is no evidence for itself; its odds against the global ones
        multiply the document's odds."""
        site = (F.col("_s") - p + F.col("_strength") * F.col("_prior")) / (F.col("_n") - 1 + F.col("_strength"))
        site = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), site))
        odds = F.greatest(F.lit(1e-9), p) / F.greatest(F.lit(1e-9), 1 - p) * (site / (1 - site)) / (self.mean / (1 - self.mean))
        return odds / (1 + odds)


def _strength(groups: DataFrame, mean: Column) -> Column:
    """Of a beta prior around `mean`, by the method of moments over groups (_n, _s, _q: count, sum and sum of squares):
    how far groups lie apart beyond what documents within them vary. Few or equal groups give a strong prior."""
    within = F.sum(F.greatest(F.lit(0.0), F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n"))) / F.greatest(F.lit(1.0), F.sum(F.col("_n") - 1))
    between = F.sum(F.col("_n") * F.pow(F.col("_s") / F.col("_n") - mean, 2)) - within * F.count("*")
    spread = F.greatest(F.lit(1e-6), between / F.greatest(F.lit(1.0), F.sum("_n")))
    base = F.sum(F.col("_n") * mean * (1 - mean)) / F.greatest(F.lit(1.0), F.sum("_n"))
    return F.greatest(F.lit(2.0), F.least(F.lit(10_000.0), base / spread - 1))


def sites(scores: DataFrame) -> Sites:
    """From _host, _path, _p of all documents. Paths are shrunk toward their host, hosts toward the global share: by
    sums for each path, then each host, combined before they are exchanged. Only the three global figures reach the
    driver; the table is stored, and is broadcast later only if Spark finds it small."""
    path = stored(scores.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("_n"), F.sum("_p").alias("_s"), F.sum(F.col("_p") * F.col("_p")).alias("_q")))
    host = stored(path.groupBy("_host").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q")))
    total = host.agg(F.sum("_s") / F.sum("_n")).first()[0]
    mean = min(max(total if total is not None else 0.5, 1e-4), 1 - 1e-4)
    strong = host.agg(_strength(host, F.lit(mean))).first()[0] or 2.0
    host = host.select(F.col("_host").alias("_h"), ((F.col("_s") + strong * mean) / (F.col("_n") + strong)).alias("_prior"))
    both = path.join(host, F.col("_host") == F.col("_h"))
    narrow = both.agg(_strength(both, F.col("_prior"))).first()[0] or 2.0
    return Sites(stored(both.select("_host", "_path", "_n", "_s", "_prior", F.lit(float(narrow)).alias("_strength"))), mean)


def _place(host: str, path: str) -> list[Column]:
    """Null hosts and paths count as empty."""
    return [F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path")]


def judged(docs: DataFrame, model: hashed.Model, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, host, path, evidence, posterior, kept of every row of `docs`. Texts are read once; what is exchanged is
    numbers. An empty table gives none."""
    prepared(docs.sparkSession)
    scores = stored(docs.select("doc_id", *_place(host, path), evidence(model).alias("_p")))
    known = sites(scores)
    site = known.table.withColumnRenamed("_host", "_h").withColumnRenamed("_path", "_t")
    posterior = known.posterior(F.col("_p"))
    joined = scores.join(site, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_t")))
    return joined.select("doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_p").alias("evidence"), posterior.alias("posterior"), (posterior >= threshold).alias("kept"))


def kept(docs: DataFrame, model: hashed.Model, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that judged() keeps, with their own columns, whatever they are called. Rows are judged
    once, and stored with their evidence; if Spark finds the table of sites small, they are not exchanged."""
    prepared(docs.sparkSession)
    own = stored(docs.select(F.struct("*").alias("_doc"), *_place(host, path), evidence(model).alias("_p")))
    known = sites(own.select("_host", "_path", "_p"))
    site = known.table.withColumnRenamed("_host", "_h").withColumnRenamed("_path", "_t")
    joined = own.join(site, (F.col("_host") == F.col("_h")) & (F.col("_path") == F.col("_t")))
    return joined.where(known.posterior(F.col("_p")) >= threshold).select("_doc.*")


def document_model(docs: DataFrame, labels: DataFrame) -> hashed.Model:
    return hashed.fit(labelled(docs, labels, "quality", SAMPLE), prior=label_share(labels, "quality"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judged(docs, document_model(docs, read(spark, sf_dir, "labels")))
