import pytest
from pyspark.sql import functions as F

from palisade.llm import mixing
from palisade.llm.common import utf8_size
from palisade.llm.queries_mixing import WEIGHTS


@pytest.mark.parametrize("weights", [{"a": 1, "*": 1}, {"a": 7, "b": 2, "*": 1}, WEIGHTS, {"*": 5}, {"a": 1, "b": 96, "*": 3}])
def test_frame_keeps_within_a_block(spark, weights):
    rows = mixing.frame(spark, weights).collect()
    total = sum(weights.values())
    at = {r["at"]: r["class"] for r in rows}
    assert sorted(at) == list(range(total))
    done = dict.fromkeys(weights, 0)
    for t in range(total):
        done[at[t]] += 1
        assert all(abs(done[c] - (t + 1) * w / total) < 1 for c, w in weights.items())
    assert done == weights


def test_wrong_weights(spark):
    for w in ({"a": 1}, {"a": 0, "*": 1}, {"*": 20_000}):
        with pytest.raises(ValueError):
            mixing.frame(spark, w)


def test_mix(odd, empty):
    weights = {"src0": 3, "src1": 1, "*": 2}
    assert mixing.mix(empty, weights, F.col("n_chars")).count() == 0
    out = mixing.mix(odd, weights, utf8_size(F.col("text")), block=500)
    assert set(odd.columns) == set(out.columns)
    rows = out.select("doc_id", "source", "text", "mix.*").collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["class"] == (r["source"] if r["source"] in weights else "*") and r["release"] <= r["slot"] < r["deadline"]
        assert r["block"] == r["start"] // 500
    for c in weights:
        own = sorted((r["start"], len((r["text"] or "").encode())) for r in rows if r["class"] == c)
        at = 0
        for start, n in own:
            assert start == at
            at += n
    slots = {}
    for r in rows:
        slots.setdefault(r["slot"], set()).add((r["class"], r["block"]))
    assert all(len(s) == 1 for s in slots.values())


def test_in_order_keeps_rows(spark, odd, tmp_path):
    weights = {"src0": 3, "src1": 1, "*": 2}
    out = mixing.in_order(odd, weights, utf8_size(F.col("text")), block=500, per_part=2)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    slots = {(r["doc_id"], r["text"]): r["mix"]["slot"] for r in mixing.mix(odd, weights, utf8_size(F.col("text")), block=500).collect()}
    got = [slots[r["doc_id"], r["text"]] for r in out.select("doc_id", "text").collect()]
    assert got == sorted(got)
