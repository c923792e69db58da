"""Quality rules for documents, with host verdicts from shrunken failure rates.

Per document: counts of words, symbols, repeated lines and repeated passages, in
column expressions over the whole text.  A document fails the base rules if it has
fewer than 10 words or more than a fifth of its words are in repeated 5-word
windows.  It is doubtful if it passes those but has a symbol for every ten words, words of
less than 2 or more than 15 characters on average, or a repeated line for every ten words.

Hosts: failures and documents are summed by domain (the column ``source``).  A beta prior is fitted
to the hosts' rates by moments, and each host's rate is shrunk towards the prior mean, so that a
host of few documents is not condemned by chance.  A host whose shrunken rate is above ``SUSPECT``
is suspect.  Doubtful documents of suspect hosts go; documents that no rule finds fault with stay on any host.

Within one text, equal 5-word windows are found by sorting their 64-bit digests, so the cost grows
as n log n with the number of words.

Defined results: a null or empty text has no words and fails; a missing source is a host; rows are judged one by one,
repeated or not; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidycell.llm.common import stage

WINDOW = 5
SUSPECT = 0.5
SYMBOLS = "#*$%&|<>"


def _windows(h: Column, width: int) -> Column:
    """Digests of all runs of ``width`` (5) entries; empty if there are fewer."""
    def pairs(a: Column, b: Column, gap: int) -> Column:
        size = F.greatest(F.size(b) - F.lit(gap), F.lit(0))
        return F.zip_with(F.slice(a, 1, size), F.slice(b, 1 + gap, size), lambda x, y: F.xxhash64(x, y))

    two = pairs(h, h, 1)
    four = pairs(two, two, 2)
    size = F.greatest(F.size(h) - F.lit(width - 1), F.lit(0))
    return F.zip_with(F.slice(four, 1, size), F.slice(h, width, size), lambda x, y: F.xxhash64(x, y))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    step = docs.withColumns({
        "__words": F.transform(words, lambda w: F.xxhash64(w)),
        "__word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"),
        "__n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "__n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    })
    step = step.withColumn("__n_words", F.size("__words").cast("long")).withColumn("__w", _windows(F.col("__words"), WINDOW)).drop("__words")
    # Most texts repeat nothing; only for the others the windows are sorted with their places.
    sorted_ = F.when(F.size(F.array_distinct("__w")) < F.size("__w"), F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("__s", sorted_).drop("__w")
    n = F.size("__s")
    here, after, before = F.col("__s"), F.slice("__s", 2, F.greatest(n, F.lit(1))), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.col("__s"))
    flags = F.zip_with(F.zip_with(here, after, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("f"))),
                       before, lambda a, b: F.struct(a["i"].alias("i"), (a["f"] | F.coalesce(a["h"] == b["h"], F.lit(False))).alias("f")))
    step = step.withColumn("__p", F.sort_array(F.transform(F.filter(flags, lambda x: x["f"]), lambda x: x["i"]))).drop("__s")
    p = F.col("__p")
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return step.withColumn("__n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))).drop("__p")


def base_failed() -> Column:
    return (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))


def doubtful() -> Column:
    n, chars = F.col("__n_words"), F.col("__word_chars")
    return (10 * F.col("__n_symbols") > n) | (chars < 2 * n) | (chars > 15 * n) | (10 * F.col("__n_dup_lines") > n)


def hosts(counted: DataFrame, suspect: float = SUSPECT) -> DataFrame:
    """(host, docs, failures, rate, suspect): failures of the rules by domain, shrunk by a beta prior.

    The prior is fitted by moments to the rates of all hosts, each weighing the same; hosts that do not
    differ give a prior so strong that all have its mean.
    """
    by_host = counted.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("docs"), F.sum((base_failed() | doubtful()).cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("docs")
    prior = by_host.agg(F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"))
    strength = F.col("mean") * (1 - F.col("mean")) / F.when(F.col("var") > 0, F.col("var")) - 1
    prior = prior.select(F.struct("mean", F.greatest(F.coalesce(strength, F.lit(1e9)), F.lit(1e-3)).alias("strength"))).scalar()
    shrunk = (F.col("failures") + prior["mean"] * prior["strength"]) / (F.col("docs") + prior["strength"])
    return by_host.select("host", "docs", "failures", shrunk.alias("rate"), (shrunk > suspect).alias("suspect"))


def verdicts(counted: DataFrame, known: DataFrame) -> DataFrame:
    """``counted`` with __base_failed, __suspect and __kept."""
    rows = counted.join(known.select(F.col("host").alias("__host"), F.col("suspect").alias("__suspect")), F.col("source").eqNullSafe(F.col("__host"))).drop("__host")
    # One condition over both sides of the join: split, a part would be pushed below the counts and take them again.
    kept = F.when(base_failed(), False).when(F.col("__suspect"), ~doubtful()).otherwise(True)
    return rows.withColumns({"__base_failed": base_failed(), "__kept": kept})


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns.  The counts are taken once and written with the documents, from
    where the host sums read the counts alone; no text is shuffled."""
    counted = stage(counts(docs), "counts")
    return verdicts(counted, stage(hosts(counted), "hosts")).where("__kept").select(*docs.columns)
