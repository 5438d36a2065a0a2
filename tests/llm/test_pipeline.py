import re
import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from palisade.llm import secrets
from palisade.llm.queries_mixing import WEIGHTS

sys.path.insert(0, str(Path(__file__).parent))
from test_packing import check  # noqa: E402
from test_quality import plain as figures  # noqa: E402
from test_secrets import slow  # noqa: E402
from test_simhash import plain as simhash  # noqa: E402


def redacted(text):
    out, at = "", 0
    for a, _, b in slow(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def survivors(texts, similarity):
    """Ids that stay if pairs within 2 bits, or as similar by 5-word shingles, are one group."""
    sets, prints = {}, {i: simhash(t) for i, t in texts.items()}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in texts}


def test_stages(spark, small, tables, tmp_path):
    """Each stage against a plain version; on this table too few labels certify a cutoff, so only base rules reject."""
    docs = tables["documents"]
    given = {r["doc_id"]: r for r in docs.collect()}

    def passes(text):
        n, _, _, _, repeats = figures(text)
        return n >= 50 and 100 * repeats <= 50 * n

    want = {i: r["text"] for i, r in given.items() if passes(r["text"])}
    results = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert docs.columns == tables["documents"].columns
        results.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert results[0] == want
    assert set(results[1]) == survivors(want, 0.8) and len(results[1]) < len(want)
    assert all(want[i] == t for i, t in results[1].items())
    clean = {i: redacted(t) for i, t in results[1].items()}
    assert results[2] == results[3] == clean
    assert all(r["n_chars"] == (len(r["text"]) if "[SECRET]" in r["text"] else given[r["doc_id"]]["n_chars"]) for r in docs.collect())
    rows = corpus_pipeline.STAGES[4][1](spark, docs, small).collect()
    assert check(rows, clean) < 0.05
    assert [(r["doc_id"], r["start"], r["sequence_id"]) for r in sorted(rows, key=str)] == [(r["doc_id"], r["start"], r["sequence_id"]) for r in sorted(corpus_pipeline.run(spark, small).collect(), key=str)]


def test_odd_rows(spark, odd, empty, small, tmp_path):
    for label, docs in (("odd", odd), ("empty", empty)):
        columns = docs.columns
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{label}{number}")
            docs = spark.read.parquet(f"{tmp_path}/{label}{number}")
            assert number == 4 or docs.columns == columns
        assert docs.count() == 0 if label == "empty" else docs.count() > 0


def test_certified_cutoffs(spark, tmp_path):
    """With enough labelled good documents the first stage rejects junk as well, and keeps every clean document."""
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "src0", 9) for i in range(700)]
    junk = [(1000 + i, " ".join(f"w{i}y{j}$$$***" for j in range(60)), "en", "src0", 9) for i in range(30)]
    other = [(2000 + i, " ".join(f"w{i}z{j}$$$***" for j in range(60)), "de", "src0", 9) for i in range(3)]
    docs = spark.createDataFrame(clean + junk + other, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, 0) for i in range(700)] + [(1000, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, *_ in clean + other}  # without labels in its stratum, junk in another language stays


def test_columns_of_any_name(spark, small, tables, tmp_path):
    """Columns named like those that stages use pass through, and change no result."""
    names = ["row", "key", "uid", "fp", "name", "size", "prefix", "root", "first", "_pl_kept", "_pl_root", "_quality", "_masked", "_stratum", "_cut", "mix", "_class", "_k", "_row", "_cell", "_size", "_rank"]
    plain = wide = tables["documents"].limit(60).select("doc_id", "text", "lang", "source", "n_chars")
    plain = spark.createDataFrame(plain.collect(), plain.schema)
    wide = plain.withColumns({n: F.lit(n) for n in names})
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        for label, docs in (("plain", plain), ("wide", wide)):
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{label}{number}")
        plain, wide = (spark.read.parquet(f"{tmp_path}/{label}{number}") for label in ("plain", "wide"))
        assert wide.columns == [*plain.columns, *names]
        assert wide.filter(" OR ".join(f"`{n}` <> '{n}'" for n in names)).count() == 0
        assert sorted(map(tuple, wide.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "secret scan", "source mix", "packing"]
    assert sum(WEIGHTS.values()) == 100 and all(re.fullmatch(r"[a-z_]+", r.kind) for r in secrets.RULES)
