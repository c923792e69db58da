"""Personal data by fixed forms, and identifiers that appear in the same contexts.

Base: e-mail addresses, IP addresses, card and phone numbers, each found leftmost
and without overlap, then checked.  The method: bootstrapped contextual extraction.

1. Seeds are the base finds.  Candidates are the other words with a digit.  Each
   occurrence has patterns: the word before it, and the two words before it, lower-cased and with
   digits written as 0.  Words of finds and candidates before it count; a word ends where one of these does.
2. Patterns and instances (distinct strings) form a graph.  Seeds score 1, candidates 0 at first.
   In each round a pattern's score is the mean over its instances, shrunk towards 0
   by ``DOUBT`` instances, and a candidate's score the best of its patterns with ``SUPPORT`` held instances
   or more; held are the seeds at first.
3. Candidates in a pattern with a score of ``SURE`` or more after ``ROUNDS`` rounds, of ``SHORTEST`` characters
   or more with ``DIGITS`` digits, are found as kind ``context``.
4. They are held from then on, starting at their pattern's score, and the rounds begin anew, until no pattern is
   added.  What is not held starts at 0 each time, so that a pattern does not become sure by its own candidates.

Everything is in column expressions and joins.  A text is marked with a control
character round each match and split there, so its parts are gaps and matches in
turn, and lengths give positions; running sums take two levels, so the cost is
in proportion to the number of matches.  Only matches, not texts, are shuffled.

Defined results: a null text counts as empty; rows are searched one by one, repeated or not; an empty table
gives an empty result; extra columns are not read; a U+0001 in a text counts as any other control character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidycell.llm.common import stage

#: The four forms as given, written so that no text makes the matcher start or step back more than in
#: proportion to its length: a match begins where the run of its first characters begins, or at the end of
#: the match before; the last repetition keeps what it took.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

_S = r"\x20\x09-\x0D"
#: Any base find, or else a word with a digit.
_LONG_CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,18}+(?![0-9])"
_WORD = rf"(?<![^{_S}])[^{_S}0-9]*+[0-9][^{_S}]*+"
MARK = "\x01"

DOUBT = 2.0
SUPPORT = 5
SURE = 0.6
ROUNDS = 3
SHORTEST = 6
DIGITS = 3
LEVEL = 256


def _parts(text: Column, pattern: str) -> Column:
    """Gap, match, gap, ..., gap."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


def _running(lengths: str) -> Column:
    """For an array of lengths: the sum before each entry.  Two levels, so that no array is built by
    appending to one longer than ``LEVEL`` or a ``LEVEL``-th of the input."""
    return F.expr(f"""flatten(zip_with(
        aggregate(sequence(0, cast((size({lengths}) - 1) div {LEVEL} as int)), named_struct('t', 0L, 'a', cast(array() as array<bigint>)),
            (s, c) -> named_struct('t', aggregate(slice({lengths}, c * {LEVEL} + 1, {LEVEL}), s.t, (x, y) -> x + y), 'a', concat(s.a, array(s.t)))).a,
        sequence(0, cast((size({lengths}) - 1) div {LEVEL} as int)),
        (start, c) -> aggregate(slice({lengths}, c * {LEVEL} + 1, {LEVEL}), named_struct('t', start, 'a', cast(array() as array<bigint>)),
            (s, x) -> named_struct('t', s.t + x, 'a', concat(s.a, array(s.t)))).a))""")


def _matches(parts: str, starts: str, before: bool) -> Column:
    """(start, end, match, and if asked for the text before it back to the last match but one) of every match.

    A match has a word or more, so that text has the two words before if there are any; every part is
    in two of these texts at most."""
    context = f", 'before', array_join(slice({parts}, greatest(1, 2 * i - 4), least(2 * i - 1, 4)), ' ')" if before else ""
    return F.expr(f"""transform(sequence(1, cast((size({parts}) - 1) div 2 as int)), i -> named_struct(
        'start', element_at({starts}, 2 * i), 'end', element_at({starts}, 2 * i) + length(element_at({parts}, 2 * i)),
        'match', element_at({parts}, 2 * i){context}))""")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(_digits(c)), "(?<=.)(?=.)"), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda p: p.rlike("^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$|^0+$"))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _find(rows: DataFrame, name: str, pattern: str, maybe: Column, before: bool = False) -> DataFrame:
    """``rows`` with the matches of a pattern as an array column; empty where ``maybe`` is false."""
    rows = rows.withColumn("__parts", F.when(maybe, _parts(F.col("__clean"), pattern)))
    rows = rows.withColumn("__parts", F.when(F.size("__parts") > 1, F.col("__parts")))
    rows = rows.withColumn("__lengths", F.transform("__parts", F.length)).withColumn("__starts", _running("__lengths"))
    found = F.when(F.col("__parts").isNotNull(), _matches("__parts", "__starts", before)).otherwise(F.expr(f"cast(array() as array<struct<start: bigint, end: bigint, match: string{', before: string' if before else ''}>>)"))
    return rows.withColumn(name, found).drop("__parts", "__lengths", "__starts")


def _span_text(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def base(docs: DataFrame) -> DataFrame:
    """(doc_id, __row, one array of spans per kind, __any): __any has every base-like or digit-bearing
    word with its patterns.  Staged: __row is unique and keeps its value."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("__row"), F.translate(text, MARK, "\x02").alias("__clean"))
    clean = F.col("__clean")
    digit = clean.rlike("[0-9]")
    for kind, pattern, maybe in (("email", EMAIL, F.instr(clean, "@") > 0), ("ip", IP, digit), ("card", CARD, digit), ("phone", PHONE, F.instr(clean, "+") > 0)):
        rows = _find(rows, f"__{kind}", pattern, maybe)
        rows = rows.withColumn(f"__{kind}", F.transform(F.filter(f"__{kind}", lambda s: valid(kind, s["match"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    likely = f"{EMAIL}|{IP}|{_LONG_CARD}|{PHONE}"
    rows = _find(rows, "__any", f"{likely}|{_WORD}", digit | (F.instr(clean, "@") > 0), before=True).drop("__clean")

    def described(s: Column) -> Column:
        words = F.filter(F.split(s["before"], f"[{_S}]+"), lambda w: w != "")
        words = F.transform(F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), 2), lambda w: F.regexp_replace(F.lower(w), "[0-9]", "0"))
        one = F.element_at(words, F.when(F.size(words) > 0, F.lit(-1)))
        two = F.array_join(words, " ")
        m = s["match"]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(m).alias("instance"), m.rlike(f"^(?:{likely})$").alias("seed"),
                        ((F.length(m) >= SHORTEST) & (F.length(_digits(m)) >= DIGITS)).alias("fit"),
                        F.when(F.size(words) > 0, F.xxhash64(F.lit(1), one)).alias("p1"), F.when(F.size(words) > 1, F.xxhash64(F.lit(2), two)).alias("p2"))

    return stage(rows.withColumn("__any", F.transform("__any", described)), "pii")


def _occurrences(found: DataFrame) -> DataFrame:
    """(__row, start, end, instance, seed, fit, pattern)."""
    each = found.select("__row", F.explode("__any").alias("o")).select("__row", "o.*")
    return each.withColumn("pattern", F.explode(F.array("p1", "p2"))).drop("p1", "p2").where("pattern is not null")


def _scored(start: DataFrame, rounds: int) -> DataFrame:
    """(pattern, score) of the patterns that are sure after some rounds over the graph, from edges with the
    score ``known`` that their instance starts with and whether it is ``held``."""
    now = start.withColumn("score", F.col("known"))
    for k in range(rounds):
        scored = now.groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + DOUBT)).alias("p_score"), F.sum(F.col("held").cast("long")).alias("support"))
        if k == rounds - 1:
            return scored.where((F.col("support") >= SUPPORT) & (F.col("p_score") >= SURE)).select("pattern", F.col("p_score").alias("score"))
        scored = stage(scored, "patterns")
        good = scored.where(F.col("support") >= SUPPORT).select("pattern", "p_score")
        best = start.join(good, "pattern").groupBy("instance").agg(F.max("p_score").alias("i_score"))
        now = stage(start.join(best, "instance", "left").withColumn("score", F.greatest("known", F.coalesce("i_score", F.lit(0.0)))).drop("i_score"), "instances")
    raise ValueError("at least one round")


def patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score) of the patterns that are sure, with what they find held in turn until none is added."""
    edges = stage(_occurrences(found).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("fit").alias("fit")), "edges")
    start, n = edges.withColumns({"known": F.col("seed").cast("double"), "held": F.col("seed")}), 0
    while True:
        sure = stage(_scored(start, rounds), "sure")
        if (now := sure.count()) <= n:  # scores only rise, so the patterns of a pass are among those of the next
            return sure
        n = now
        taken = edges.where("fit and not seed").join(sure, "pattern").groupBy("instance").agg(F.max("score").alias("taken"))
        start = stage(edges.join(taken, "instance", "left").select(
            "pattern", "instance", "seed", "fit", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("taken", F.lit(0.0))).alias("known"),
            (F.col("seed") | F.col("taken").isNotNull()).alias("held")), "held")


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_context, base, spans): base and spans as
    ``kind:start:end`` in order of kind and start, joined by commas."""
    found = base(docs)
    sure = patterns(found)
    learned = _occurrences(found).where("fit and not seed").join(sure.select("pattern"), "pattern").select("__row", "start", "end").distinct()
    learned = learned.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__context"))
    rows = found.drop("__any").join(learned, "__row", "left").withColumn("__context", F.coalesce("__context", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")))
    texts = [_span_text(k, F.col(f"__{k}")) for k in KINDS]
    return rows.select(
        "doc_id", *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in (*KINDS, "context")),
        F.array_join(F.concat(*texts), ",").alias("base"), F.array_join(F.concat(*texts, _span_text("context", F.col("__context"))), ",").alias("spans"))
