"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Each document gets repetition and symbol figures. Fixed base rules reject some documents outright. For the others,
every signal has a fixed grid of cutoffs, and labelled good documents decide which of them may be used: with k of n
good documents of a stratum beyond a cutoff, the cutoff is certified if the exact binomial (Clopper-Pearson) upper
bound on the share of good documents beyond it is at most alpha over the number of signals. The cutoffs of a signal are
tested in a fixed sequence from the loosest one, up to the first that fails, which needs no correction within the
signal; the level is delta over the number of signals and strata (Bonferroni). With probability 1 - delta, no stratum
then loses more than alpha of its good documents to the certified cutoffs. The tightest certified cutoff applies;
without one, the signal rejects nothing.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rules; null is a stratum like
any other; a stratum without enough labelled good documents has no certified cutoff; labels that repeat count once by
their largest quality, null labels not at all; a labelled id that repeats counts once in each of its strata, by its
largest figures; without labels only the base rules reject. Repeated rows and ties get equal verdicts. Other columns
pass through; the figures are held in one struct, whose name can be chosen and replaces a column of that name.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import let, materialise, once, unused, words

#: Signal to its expression over the figures and its grid of cutoffs; a document beyond (>) the cutoff is rejected.
SIGNALS = {
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", [*range(50, 1050, 50)]),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_words, 1)", [*range(2, 42, 2)]),
    "long_words": ("word_chars * 100 div greatest(n_words, 1)", [*range(600, 1600, 50)]),
    "short_words": ("-(word_chars * 100 div greatest(n_words, 1))", [*range(-400, -200, 10)]),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", [*range(50, 500, 25)]),
}
ALPHA, DELTA = 0.05, 0.05


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows whose content occurs twice or more. Windows are told apart by 64-bit hashes and
    sorted, so the cost is n log n even for very long texts."""

    def covered(p):
        gaps = F.transform(p, lambda v, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - v, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def positions(s):
        same = lambda j, x: F.get(s, j)["g"] == x["g"]
        twice = F.filter(s, lambda x, j: same(j - 1, x) | same(j + 1, x))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def repeats(g):
        pairs = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), let(pairs, positions)).otherwise(F.lit(0).cast("long"))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 4, let(grams, repeats)).otherwise(F.lit(0).cast("long"))


def figures(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text, each long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )


def base_failed(q: str) -> Column:
    return F.expr(f"{q}.n_words < 50 OR 100 * {q}.n_repeat_words > 50 * {q}.n_words")


def _signal(name: str, q: str) -> Column:
    expr = SIGNALS[name][0]
    for field in ("n_symbols", "n_dup_lines", "word_chars", "n_repeat_words", "n_words"):
        expr = expr.replace(field, f"{q}.{field}")
    return F.expr(expr)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(at most k successes of n), term by term in logarithms."""
    step = math.log(p / (1 - p))
    term = lambda i, lt: lt + F.log((n - i + 1) / i) + F.lit(step)
    start = n * F.lit(math.log1p(-p))

    def add(state, i):
        t = term(i, state["t"])
        return F.struct(t.alias("t"), (state["s"] + F.exp(t)).alias("s"))

    rest = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(rest, F.struct(start.alias("t"), F.exp(start).alias("s")), add, lambda s: s["s"])


def thresholds(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cut) per stratum with labelled good documents; cut is a struct of a certified cutoff per signal (null: none)."""
    good = labels.groupBy(F.col(key).alias("_k")).agg(F.max("quality").alias("_g")).filter("_g = 1").select("_k")
    held = docs.select(F.col(key).alias("_k"), F.col(stratum).alias("_s"), F.col(text).alias("_t")).join(good, "_k").select("_k", "_s", once(figures(F.col("_t"))).alias("_q"))
    held = held.filter(~base_failed("_q")).select("_k", "_s", *(_signal(s, "_q").alias(s) for s in SIGNALS))
    held = held.groupBy("_k", "_s").agg(*(F.max(s).alias(s) for s in SIGNALS))  # once for each id
    beyond = [F.count(F.when(F.col(s) > c, 1)).alias(f"{s}_{i}") for s, (_, grid) in SIGNALS.items() for i, c in enumerate(grid)]
    counts = materialise(held.groupBy("_s").agg(F.count("*").alias("_n"), *beyond), "quality-counts")
    risk, level = alpha / len(SIGNALS), delta / (len(SIGNALS) * max(1, counts.count()))
    # the tighter the cutoff, the more are beyond it, so the first that fails is followed by others that do
    sure = lambda c: F.when(F.col(c) < F.col("_n") * risk, binomial_cdf(F.col(c), F.col("_n"), risk) <= level)
    cut = [F.array_min(F.array(*(F.when(sure(f"{s}_{i}"), F.lit(c)) for i, c in enumerate(grid)))).cast("long").alias(s) for s, (_, grid) in SIGNALS.items()]
    return materialise(counts.select(F.col("_s").alias("stratum"), F.struct(*cut).alias("cut")), "quality-cutoffs")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", narrow: bool = False, name: str = "_q", **how) -> DataFrame:
    """docs with a struct (figures, base_failed, kept) in the column `name`. narrow: only key and stratum are carried along.

    The thresholds are found at once, from the labelled documents; the verdicts are a pass over all documents, lazily.
    """
    carried = [key, stratum] if narrow else [c for c in docs.columns if c != name]
    by, cut = unused(docs.columns, "_stratum"), unused(docs.columns, "_cut")
    cuts = thresholds(docs, labels, key, text, stratum, **how).toDF(by, cut)
    out = docs.select(*(F.col(f"`{c}`") for c in carried), once(figures(F.col(text))).alias(name))
    passed = ~base_failed(name) & reduce(and_, (F.coalesce(_signal(s, name) <= F.col(f"{cut}.{s}"), F.lit(True)) for s in SIGNALS))
    verdict = F.struct(f"{name}.*", base_failed(name).alias("base_failed"), passed.alias("kept"))
    return out.join(cuts, F.col(f"`{stratum}`").eqNullSafe(F.col(by)), "left").withColumn(name, verdict).drop(by, cut)
