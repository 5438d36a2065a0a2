import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use."""
    plain = " ".join(f"{a}{i}" for i in range(12) for a in WORD.split())
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "src0", 0),
        (3, " \n\t", "en", "src1", 3),
        (4, plain, "en", "src0", len(plain)),
        (4, plain, "en", "src0", len(plain)),
        (5, plain, "de", "src2", len(plain)),
        (6, plain + " tail", None, "src0", 1),
        (None, "nameless text here", "fr", None, None),
        (None, "nameless text here", "fr", None, None),
        (7, "one", "xx", "srcX", 3),
        (8, "Über " * 4000, "de", "src0", 20000),
        (-9, "ÀÉ   <|endoftext|> 漢字 😀 token: abcdef123", "zz", "src0", 1),
    ]
    rows += [(100 + i, f"line {i}\n{plain[i:]}\nline {i}", "en", "src0", 9) for i in range(25)]
    extra = ", _q string, mix string, size string, shard int, slot int, _group string, fp string, secrets string, _k string, class string, key string, start string"
    filled = [(*r, "x", "y", "z", 1, 2, "g", "f", "s", "k", "c", "key", "st") for r in rows]
    return spark.createDataFrame(filled, SCHEMA + extra).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tables(spark, small):
    return {t: spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "pages", "embeddings")}
