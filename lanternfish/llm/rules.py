"""Quality rules with risk-controlled thresholds, in DataFrame expressions alone.

Figures of a text (symbols, repeated lines, repeated windows, mean word length) become rules by a cutoff each. Cutoffs
are not chosen by hand: for each rule, stratum and candidate cutoff the labelled texts give an exact binomial p-value of
the hypothesis that the rule rejects more than its share of `risk` (an equal part each) of the good ones; a step-down correction (Holm) over all tests
keeps the chance of any wrong certificate below `delta`, so that all rules
together reject at most `risk` of a stratum's good texts. Of the certified cutoffs of a rule and stratum the one that
rejects most labelled bad texts is used; a rule without one rejects nothing there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

RISK, DELTA = 0.02, 0.05
#: Candidate cutoffs, fixed beforehand: rule -> (figure, whether larger figures are rejected, cutoffs).
CANDIDATES = {
    "symbols": ("symbol_share", True, [0.01, 0.02, 0.05, 0.1, 0.2, 0.3]),
    "lines": ("line_share", True, [0.05, 0.1, 0.2, 0.3, 0.5, 0.7]),
    "repeats": ("repeat_share", True, [0.05, 0.1, 0.15, 0.2, 0.3, 0.4]),
    "long_words": ("word_length", True, [6.5, 7.0, 8.0, 9.0, 10.0, 12.0]),
    "short_words": ("word_length", False, [2.0, 2.5, 3.0, 3.5, 4.0]),
}
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body of value, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words within three-word windows that occur twice or more, the first occurrence included.

    Hashes of the windows are sorted; only texts in which two are equal go on: windows sorted with their places, those
    equal to a neighbour kept, their places sorted, and the length of the union of the stretches of three summed up."""
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    placed = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
    places = lambda s: F.sort_array(F.transform(s, lambda x: x["i"]))
    length = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    full = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed(h), lambda s: let(places(same(s)), length)))
    return F.when(F.size(words) < 4, 0).otherwise(let(hashes(words), full)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def figures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep's columns plus the counts and shares of each whole text; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    got = docs.select(*keep, one.alias("_w"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), repeated_lines(text).alias("n_dup_lines"),
                      (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("_lines"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    got = got.select(*keep, "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", "_lines")
    n = F.col("n_words")
    return got.withColumns({"symbol_share": share(F.col("n_symbols"), F.col("word_chars")), "line_share": share(F.col("n_dup_lines"), F.col("_lines")),
                            "repeat_share": share(F.col("n_repeat_words"), n), "word_length": share(F.col("word_chars"), n)}).drop("_lines")


def log_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact: the largest term from sums of logarithms, the smaller ones by their ratios. Where
    k >= n p the probability is not small and 0 stands for it."""
    ratio = p / (1 - p)
    log_choose = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, j: a + F.log(n - j + 1.0) - F.log(j.cast("double")))
    top = F.when(k < 1, F.lit(0.0)).otherwise(log_choose) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    zero = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    def down(a, j):
        t = a["t"] * j / ((n - j + 1.0) * ratio)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))
    rest = F.aggregate(F.sequence(k, F.lit(1), F.lit(-1)), zero, down, lambda a: F.log(a["s"]))
    return F.when(k >= n * p, F.lit(0.0)).otherwise(F.least(F.lit(0.0), top + F.when(k < 1, F.lit(0.0)).otherwise(rest)))


def thresholds(told: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): certified cutoffs from told, which has the figures, the stratum and good (boolean).
    A row for each stratum and rule with one."""
    tests = [(rule, figure, above, c) for rule, (figure, above, cs) in CANDIDATES.items() for c in cs]
    hit = lambda figure, above, c: (F.col(figure) > c) if above else (F.col(figure) < c)
    sums = [F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("cutoff"), F.count_if(F.col("good") & hit(f, a, c)).alias("k"), F.count_if(~F.col("good") & hit(f, a, c)).alias("gain")) for rule, f, a, c in tests]
    per = told.groupBy(F.col(stratum).alias("stratum")).agg(F.count_if("good").alias("n"), F.array(*sums).alias("tests"))
    per = per.select("stratum", "n", F.inline("tests")).where("n > 0")
    per = per.withColumn("log_p", log_tail(F.col("n").cast("int"), F.col("k").cast("int"), risk / len(CANDIDATES)))
    # Holm: of m tests the i-th smallest p-value is held against delta / (m - i + 1), and the first that fails ends it
    order = W.orderBy("log_p", "stratum", "rule", "cutoff")  # strata times candidates, a fixed few
    ranked = per.withColumn("i", F.row_number().over(order)).withColumn("m", F.count("*").over(W.partitionBy()))
    passed = ranked.withColumn("ok", F.col("log_p") <= F.log(F.lit(delta) / (F.col("m") - F.col("i") + 1)))
    held = passed.withColumn("all_ok", F.min("ok").over(order.rowsBetween(W.unboundedPreceding, 0))).where("all_ok and gain > 0")
    return held.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("k"), "cutoff")).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, extra: list[str] | None = None) -> DataFrame:
    """doc_id, the figures, base_failed and kept of every row of docs.

    base_failed: under 50 words, or over half of them in repeated windows. kept: not base_failed and no rule certified
    for the row's stratum rejects it; a null stratum is one of its own. Labels that are null or name no document do not
    count, nor do rows that the base rejects; a document with several labels is good if the largest is. Repeated rows are
    judged each; an empty table gives no rows."""
    keep = ["doc_id", *([stratum] if stratum in docs.columns else []), *(extra or [])]
    told = figures(docs, keep)
    told = told.select(*[c for c in told.columns if c != stratum], (F.coalesce(F.col(stratum), F.lit("")) if stratum in docs.columns else F.lit("")).alias("_s"))
    told = materialize(told.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))), "rules")
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    cut = thresholds(told.where("not base_failed").join(marks, "doc_id"), "_s", risk, delta)
    wide = cut.groupBy(F.col("stratum").alias("_s")).pivot("rule", list(CANDIDATES)).agg(F.first("cutoff"))
    hits = [F.coalesce((F.col(f) > F.col(rule)) if above else (F.col(f) < F.col(rule)), F.lit(False)) for rule, (f, above, _) in CANDIDATES.items()]
    rejected = hits[0]
    for h in hits[1:]:
        rejected = rejected | h
    return told.join(wide, "_s", "left").withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_s", *CANDIDATES)
