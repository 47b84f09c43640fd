"""Quality rules by document and by host, with DataFrame functions only.

Each document is judged by base rules; failures are counted by host, host rates are shrunk with
a beta prior fitted to all hosts, and the verdicts of hosts are joined back to their documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.operators.scale import materialized
from ridelake.session import shared_folder

BLANKS = " \t\n\x0b\f\r"
#: Words per window of the repetition rule.
RUN = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: A host goes when more than this share of its documents is expected to fail.
MAX_HOST_RATE = 0.5
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between blanks, in order."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words in runs of ``RUN`` words that the text holds twice or more, the first ones included.

    Runs are compared by a 64-bit hash of their words inside one document.
    """
    n = F.size(words)
    hashes = F.transform(
        F.slice(words, 1, F.greatest(n - (RUN - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, RUN)]),
    )

    def covered(ranked: Column) -> Column:
        twice = F.filter(
            ranked,
            lambda e, j: (F.get(ranked, j - 1)["h"] == e["h"]) | (F.get(ranked, j + 1)["h"] == e["h"]),
        )
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        total = F.aggregate(
            starts,
            F.struct(F.lit(-RUN).alias("last"), F.lit(0).alias("words")),
            lambda s, i: F.struct(i.alias("last"), (s["words"] + F.least(F.lit(RUN), i - s["last"])).alias("words")),
        )
        return total["words"]

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, covered))

    return let(hashes, count)


def text_statistics(text: Column) -> Column:
    """Struct of the statistics of a text (null: empty)."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    from_words = let(
        words_of(whole),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )
    return F.struct(
        from_words.alias("words"),
        F.size(F.regexp_extract_all(whole, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def base_failure(n_words: Column, n_repeat_words: Column) -> Column:
    """Whether a document fails a base rule."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def host_verdicts(docs: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_kept) from documents with ``base_failed``.

    The prior is a beta distribution with the mean of all documents and the spread of host rates
    around it (method of moments); a host's rate is the mean of its posterior. Where the spread
    says nothing (one host, no failures, equal rates) the prior has the weight of one document.
    """
    counts = docs.groupBy(host).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )
    rates = counts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("mean"),
        F.avg((F.col("n_failed") / F.col("n_docs")) * (F.col("n_failed") / F.col("n_docs"))).alias("square"),
        F.avg(F.col("n_failed") / F.col("n_docs")).alias("host_mean"),
    )
    mean, spread = F.col("mean"), F.col("square") - 2 * F.col("mean") * F.col("host_mean") + F.col("mean") * F.col("mean")
    weight = F.when((spread > 0) & (spread < mean * (1 - mean)), mean * (1 - mean) / spread - 1).otherwise(F.lit(1.0))
    prior = rates.select(F.struct(mean.alias("mean"), F.greatest(weight, F.lit(1.0)).alias("weight")).alias("prior"))
    fitted = counts.withColumn("prior", prior.scalar())
    shrunk = (F.col("n_failed") + F.col("prior.mean") * F.col("prior.weight")) / (F.col("n_docs") + F.col("prior.weight"))
    return fitted.select(
        host, "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= max_rate).alias("host_kept")
    )


def judge_documents(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """(doc_id, host, statistics, base_failed, n_docs, n_failed, shrunk_rate, host_kept, kept).

    A document is kept if it passes the base rules and its host is kept. A null text is empty and
    fails; documents without a host are judged as one host; rows that repeat an id are judged
    each for itself and count each; other columns are ignored.

    Texts are read once: the statistics are checkpointed in the shared folder, which runs their
    job. Failures are combined in each task before the shuffle by host, and the join back leaves
    the choice of its kind to Spark's size checks (broadcast under the session's threshold, else
    sort-merge with skew splitting).
    """
    found = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), text_statistics(F.col(text)).alias("s")
    ).select(
        "doc_id",
        "host",
        *[F.col(f"s.words.{c}" if c in ("n_words", "word_chars", "n_repeat_words") else f"s.{c}") for c in STATISTICS],
    )
    judged = materialized(
        found.withColumn("base_failed", base_failure(F.col("n_words"), F.col("n_repeat_words")))
    )
    verdicts = host_verdicts(judged, "host", max_rate).withColumnRenamed("host", "_host")
    joined = judged.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


def keep_documents(
    docs: DataFrame, *, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """Rows of ``docs`` that :func:`judge_documents` keeps, with their columns.

    Texts are judged once for the host counts and once more where the rows are filtered. Verdicts
    are a written table, so that Spark knows its size: while it is under the session's broadcast
    threshold the texts stay where they are. Rows that repeat an id are judged each for itself.
    """
    s = text_statistics(F.col(text))
    failed = F.transform(F.array(s), lambda x: base_failure(x["words"]["n_words"], x["words"]["n_repeat_words"]))[0]
    flagged = docs.select(F.col(host).alias("host"), failed.alias("base_failed"))
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/hosts-{uuid.uuid4().hex}"
    host_verdicts(flagged, "host", max_rate).select(F.col("host").alias("_host"), "host_kept").write.parquet(folder)
    verdicts = spark.read.parquet(folder)
    met = docs.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left")
    return met.where(F.col("host_kept") & ~failed).select(*[docs[c] for c in docs.columns])
