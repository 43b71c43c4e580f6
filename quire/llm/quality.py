"""Quality rules whose failures are judged by host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACES, text_of, words_of
from quire.operators.skew import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
HOST_LIMIT = 0.8
MOST_STRENGTH = 1e6
SALTS = 32


def _window_order(words: Column) -> Column:
    """Fingerprints of the three-word windows with their place in the low bits, sorted.

    The place takes as many bits as the number of words needs, so equal windows are
    neighbours and keep 49 bits of fingerprint or more up to 32,767 words.
    """
    return F.expr(
        "sort_array(transform(if(n_words < 3, array(), sequence(0, n_words - 3)), i -> "
        "shiftleft(xxhash64(words[i], words[i + 1], words[i + 2]), bits) | cast(i as bigint)))")


_REPEATED = """
sort_array(filter(transform(ordered, (x, i) -> if(
    coalesce(shiftright(x, bits) = shiftright(get(ordered, i - 1), bits), false)
    or coalesce(shiftright(x, bits) = shiftright(get(ordered, i + 1), bits), false),
    x & (shiftleft(1L, bits) - 1), cast(null as bigint))), x -> x is not null))
"""
_COVERED = """
aggregate(transform(places, (x, i) -> least(3L, coalesce(get(places, i + 1) - x, 3L))), 0L,
    (total, x) -> total + x)
"""


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """Adds the base figures of every text: n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, all long."""
    steps = docs.withColumn("words", words_of(text))
    steps = steps.withColumn("n_words", F.size("words"))
    steps = steps.withColumn("bits", F.length(F.bin("n_words")))
    steps = steps.withColumn("ordered", _window_order(F.col("words"))).drop("words")
    steps = steps.withColumn("places", F.expr(_REPEATED)).drop("ordered")
    steps = steps.withColumn("n_repeat_words", F.expr(_COVERED)).drop("places", "bits")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    steps = steps.withColumn("lines", lines)
    steps = steps.withColumn("n_lines", F.size("lines").cast("long")).withColumn(
        "n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).drop("lines")
    return steps.withColumns({
        "n_words": F.col("n_words").cast("long"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * 50)


def rule_failed() -> Column:
    """Any rule: the base ones, many symbols, many repeated lines, odd word lengths."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return (
        base_failed() | (F.col("n_symbols") * 5 > n)
        | (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3)
        | (chars < n * 2) | (chars > n * 15))


def rejected_hosts(judged: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts of ``judged(host, failed)`` whose shrunk failure rate is above ``limit``.

    The prior is a beta distribution fitted to the rates of all hosts by their mean and
    variance; its strength is kept between 1 and a million documents, the latter where all
    hosts have one rate. Rows without a host are not counted.
    """
    hosts = judged.where("host is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("bad"))
    hosts = cut_lineage(hosts, "hosts")
    fit = hosts.agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"),
        F.var_pop(F.col("bad") / F.col("n")).alias("spread")).first()
    mean = (fit["bad"] or 0) / (fit["n"] or 1)
    spread = fit["spread"] or 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 1e-12 else MOST_STRENGTH
    strength = min(max(strength, 1.0), MOST_STRENGTH)
    rate = (F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.where(rate > limit).select("host")


def without_hosts(judged: DataFrame, rejected: DataFrame) -> DataFrame:
    """Adds ``host_rejected``. The verdicts are read from a written table, so Spark knows
    their size and sends them to all tasks only where they are small; otherwise a host's
    rows are spread over salts."""
    known = cut_lineage(rejected, "host-verdicts")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    verdicts = known.select(
        F.col("host").alias("_host"), salts.alias("_verdict_salt"))
    salted = judged.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(
        verdicts, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_verdict_salt")),
        "left")
    return joined.withColumn("host_rejected", F.col("_host").isNotNull()).drop(
        "_host", "_salt", "_verdict_salt")


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The figures and the verdict of every row of ``docs(doc_id, text, <host>)``.

    A document is kept unless it fails a base rule or its host is rejected: the share of
    its documents that fail any rule, shrunk towards all hosts, is above ``limit``. A null
    text has no words and fails; a null host is never rejected; repeated rows count each;
    other columns are ignored; a table without rows gives none.
    """
    narrow = docs.select("doc_id", F.col(host).alias("host"), text_of().alias("text"))
    figures = measured(narrow, F.col("text")).drop("text").withColumns(
        {"base_failed": base_failed(), "failed": rule_failed()})
    judged = cut_lineage(figures, "quality")
    verdicts = without_hosts(judged, rejected_hosts(judged, limit))
    return verdicts.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that are kept by ``judge``, with their columns.

    Figures and documents are written together once, so that the text is measured once and
    never shuffled.
    """
    whole = docs.select(
        F.struct("*").alias("row"), "doc_id", F.col(host).alias("host"),
        text_of().alias("text"))
    figures = measured(whole, F.col("text")).select(
        "row", "doc_id", "host", base_failed().alias("base_failed"),
        rule_failed().alias("failed"))
    judged = cut_lineage(figures, "quality")
    verdicts = rejected_hosts(judged.select("host", "failed"), limit)
    kept = without_hosts(judged.where("not base_failed"), verdicts).where("not host_rejected")
    return kept.select("row.*")
