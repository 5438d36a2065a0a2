import math
import re

from pyspark.sql import functions as F

from palisade.llm import quality

WHITE = "[\x20\x09-\x0d]+"


def plain(text):
    text = text or ""
    w = [x for x in re.split(WHITE, text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.sub(WHITE, "", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_figures(odd):
    rows = odd.select("text", quality.figures(F.col("text")).alias("q")).collect()
    assert len(rows) > 30 and all(tuple(r["q"]) == plain(r["text"]) for r in rows if len(r["text"] or "") < 5000)
    long = next(tuple(r["q"]) for r in rows if len(r["text"] or "") > 5000)
    assert long == (4000, 16000, 0, 0, 4000)


def test_overlapping_repeats(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "x a b c y a b c z", "a b", "p q r s p q r s t"]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality.figures(F.col("text")).alias("q")).collect():
        assert tuple(r["q"]) == plain(r["text"])


def test_binomial(spark):
    cases = [(0, 10, 0.01), (3, 50, 0.02), (7, 400, 0.01), (900, 100_000, 0.01), (0, 1, 0.5)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert abs(got - want) < 1e-9 * max(1, want) + 1e-12


def test_thresholds_reject_junk_and_keep_good(spark):
    good = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    junk = lambda i: " ".join(f"w{i}x{j}$$$***" for j in range(60))
    docs = spark.createDataFrame([(i, good(i) if i % 10 else junk(i), "en") for i in range(4000)] + [(9000 + i, junk(i), "rare") for i in range(5)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(4000)] + [(1, None), (5, 0), (None, 1)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).select("doc_id", "_q.kept").collect()}
    assert all(kept[i] == (i % 10 > 0) for i in range(4000))
    assert all(kept[9000 + i] for i in range(5))  # too few good ones to certify a cutoff there


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(empty, labels).count() == 0
    out = quality.judge(odd, labels)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns)
    for r in out.select("text", "_q.*").collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])


def test_sequence_of_tests(spark):
    """With a fixed sequence some hundred good documents are enough, and an id that repeats counts as one of them."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    junk = lambda i: " ".join(f"w{i}x{j}$$$***" for j in range(60))

    def certified(ids):
        rows = [(i, text(n), "en") for n, i in enumerate(ids)] + [(10_000 + i, junk(i), "en") for i in range(5)]
        labels = spark.createDataFrame([(i, 1) for i in set(ids)], "doc_id long, quality int")
        out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
        return not any(r["kept"] for r in out.filter("doc_id >= 10000").select("_q.kept").collect())

    need = math.ceil(math.log(quality.DELTA / len(quality.SIGNALS)) / math.log1p(-quality.ALPHA / len(quality.SIGNALS)))
    assert 400 < need < 500 and certified(range(need)) and not certified(range(need - 1))
    assert not certified([i % (need - 1) for i in range(3 * need)])


def test_strata_stand_alone(spark):
    """A cutoff that one stratum certifies says nothing about others, null among them."""
    junk = lambda i: " ".join(f"w{i}x{j}$$$***" for j in range(60))
    plain_text = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, plain_text(i), (None, "en")[i % 2]) for i in range(2000)] + [(5000 + i, junk(i), (None, "en", "de")[i % 3]) for i in range(9)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, _stratum string, _cut string")
    labels = spark.createDataFrame([(i, 1) for i in range(2000)], "doc_id long, quality int")
    out = quality.judge(docs, labels)
    assert out.columns == [*docs.columns, "_q"]
    assert {r["doc_id"] - 5000: r["kept"] for r in out.filter("doc_id >= 5000").select("doc_id", "_q.kept").collect()} == {i: i % 3 == 2 for i in range(9)}
