"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured against a few rules; failures are counted by
host, each host's rate is shrunk towards all hosts' rate by a beta prior
fitted to the hosts themselves, and a host whose shrunk rate passes the
limit is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import ASCII_SPACES, staged

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
SYMBOLS = "#*$%&|<>"
#: Shrunk failure rate above which a host is rejected.
MAX_HOST_RATE = 0.5
#: Limits of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column, window: int) -> Column:
    """Words inside windows that occur twice or more in the list.

    Windows are compared by 64-bit hashes.  Only lists with a repeated hash
    are sorted; the rest costs one pass."""
    hashes = F.when(F.size(words) >= window, F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)),
                                                         lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def starts(s: Column) -> Column:
            def at(k: Column) -> Column:
                here = F.get(s, k)
                twin = F.coalesce(F.get(s, k - 1)["h"] == here["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == here["h"], F.lit(False))
                return F.when(twin, here["at"])
            return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), at), lambda x: x.isNotNull()))

        def total(p: Column) -> Column:
            step = F.transform(F.sequence(F.lit(0), F.size(p) - 1),
                               lambda k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(window))))
            return F.aggregate(step, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(in_order, starts), total))

    return _let(hashes, covered)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of each document.

    Null and empty texts have zero of everything and fail the word rule; a
    line counts as duplicate if it holds a word and equals an earlier line;
    every occurrence of a repeated word window counts, the first included.
    """
    text = F.coalesce("text", F.lit(""))
    trimmed = F.trim(F.translate(text, ASCII_SPACES, " " * len(ASCII_SPACES)))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, " +"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                            _repeated_words(w, REPEAT_WINDOW).cast("long").alias("n_repeat_words")))
    spaces = ASCII_SPACES + " "
    return docs.select(
        "doc_id", F.col("source").alias("host"), counts.alias("c"),
        F.length(F.translate(text, spaces, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    ).select("doc_id", "host", "c.n_words", "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.dup").alias("n_dup_lines"), "c.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def rule_failures() -> dict[str, Column]:
    """The rules whose failures count against a host."""
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") * 100 > F.col("word_chars") * MAX_SYMBOL_PERCENT,
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * MAX_DUP_LINE_PERCENT,
    }


def host_verdicts(stats: DataFrame, failed: Column, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n, failures, rate (shrunk), host_ok.  The prior's mean is the rate
    over all documents; its strength comes from the spread of the hosts' rates
    beyond what chance explains.  Two sums reach the driver."""
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(failed, 1)).alias("failures"))
    n, bad, count = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("failures"), F.lit(0)), F.count(F.lit(1))).first()
    mean = bad / n if n else 0.0
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failures") / F.col("n") - mean, 2))).first()[0] or 0.0
    chance = mean * (1 - mean)
    between = (spread - count * chance) / n if n else 0.0
    strength = MAX_STRENGTH if between <= 0 else min(max(chance / between - 1, MIN_STRENGTH), MAX_STRENGTH)
    rate = (F.col("failures") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_ok", F.col("rate") <= max_rate)


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """document_stats plus failed rules, ``base_failed``, the host's ``rate`` and
    ``host_ok``, and ``kept``.

    Documents without a host share one verdict.  Repeated rows count each.
    Columns beyond doc_id, text and source are not looked at.  Empty input:
    no rows."""
    rules = rule_failures()
    stats = staged(spark, document_stats(docs).withColumns({f"fails_{k}": v for k, v in rules.items()}), "quality-stats")
    failed = F.greatest(*[F.col(f"fails_{k}") for k in rules])
    hosts = host_verdicts(stats, failed).withColumnRenamed("host", "h")
    return (stats.join(hosts.select("h", "rate", "host_ok"), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
            .withColumnRenamed("fails_base", "base_failed").withColumn("kept", ~F.col("base_failed") & F.col("host_ok")))
