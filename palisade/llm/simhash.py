"""Near-duplicates by SimHash fingerprints.

Equal fingerprints are first merged into classes, so copies never form pairs. Fingerprints are cut into 4 blocks; two
that differ in at most 2 bits share at least 2 whole blocks, so each class enters 6 tables keyed by two blocks (32
bits), is joined with the classes under the same key, and pairs are verified by their Hamming distance. A key under
which more than BUCKET classes meet would give a quadratic number of pairs; there an exact linear way applies: every
member files itself under its fingerprint and under each fingerprint one bit away. Two members meet under a filed value
exactly if they differ in at most 2 bits, and each is linked to the smallest fingerprint filed there. Components come
from alternating large-star and small-star steps (Kiveris et al., 2014) over the distributed links, written to the
shared folder between rounds.

Texts that are alike but further apart than that are found by `similar_links`, which `deduplicated` adds: all pairs whose
sets of 5-word shingles have a Jaccard similarity of at least 0.8. Texts with equal sets are merged first. Two sets of
that similarity share a shingle among the first fifth of each in any order that is the same for all (prefix filter),
whatever the number of documents. The order is by frequency in a sample, then by hash: the sample only keeps common
shingles out of the prefixes, and no result depends on it. A pair is looked for under the first shingle that both hold:
there, all that they have in common lies in what is left of either set, so a set of which too little is left for its size
and the smallest set under the shingle has no partner there. Sets of about the same size even share many shingles of
their prefixes (some 9 % of a set), so those that hold few shingles of other prefixes have no such partner. Under each
shingle all members are first compared with two of them: the one with the least part of it gone, which is nearest to the
text that copies were made from, and one by hash, which is the same under many shingles. That puts most near copies into
components. Then every other pair under the shingle is compared that is in reach and whose members are still in different
components, but for pairs that have met under one of the few shingles before. So no pair that could join two components
is left out. Candidates are verified exactly, on the sets of shingles of the two texts.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and are linked like any other;
with fewer words than a shingle has, the whole sequence is the one shingle. Ties and repeated rows share a component,
whose id is the smallest id in it; rows with a null id have a fingerprint and take the component of their class, null
if all its ids are null. Only id and text are used, so other columns can't clash. Where an id repeats with different
texts, each row goes with its own text; `deduplicated` keeps one row of each component, the one with the smallest id
(nulls last), of equal ids the first row of the input.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import by_value, materialise, release

by_value(__name__)
WIDTH, SEED, DISTANCE, BLOCKS, BUCKET = 3, 42, 2, 4, 32
CHUNK = 1 << 16
SIMILAR, WIDE_WIDTH = 0.8, 5
#: Documents of which shingles are counted, and the most frequent shingles that are told apart by their counts.
SAMPLE, RANKED = 10_000, 1 << 16
#: Shingles before a shared one in which an earlier shared one is looked for.
RECENT = 8


def spans(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each begins and ends."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    return b" ".join(found), np.concatenate(([0], ends[:-1] + 1)), ends


def hashed(words: tuple[bytes, np.ndarray, np.ndarray], width: int, seed: int = SEED):
    """Arrays of hashes of the shingles of spans, at most CHUNK each; none if there are no words."""
    joined, starts, ends = words
    if not len(ends):
        return
    n = max(1, len(ends) - width + 1)
    firsts, lasts = starts[:n].tolist(), ends[min(width, len(ends)) - 1 :].tolist()
    for at in range(0, n, CHUNK):
        shingles = [joined[a:b] for a, b in zip(firsts[at : at + CHUNK], lasts[at : at + CHUNK], strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, from the highest; hashes: rows of 64-bit lanes."""
    lanes = hashes.astype(">u8").reshape(len(hashes), -1).view(np.uint8)
    total = np.zeros(lanes.shape[1] * 8, np.int64)
    for at in range(0, len(lanes), 255 * 32):  # sums of up to 255 bits fit a byte
        bits = np.unpackbits(lanes[at : at + 255 * 32], axis=1)
        for i in range(0, len(bits), 255):
            total += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return total


def simhash(words: tuple[bytes, np.ndarray, np.ndarray], width: int = WIDTH, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash; a bit is set if more than half of the shingle hashes, repeats included, set it."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in hashed(words, width, seed):
        counts += bit_counts(hashes)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    return simhash(spans(text), width, seed)


def _fp_udf(width: int, seed: int):
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64))

    return fp


def shingle_set(words: tuple[bytes, np.ndarray, np.ndarray]) -> np.ndarray:
    """The distinct hashes of the WIDE_WIDTH-word shingles, in ascending order."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashed(words, WIDE_WIDTH)]))


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's shingles, rare ones first, that each set of that similarity has one of its own in common."""
    if not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    rank = np.where(common[at] == hashes, counts[at], 0) if len(common) else np.zeros(len(hashes), np.int64)
    return hashes[np.lexsort((hashes, rank))][: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]


def _figures_udf(common: np.ndarray, counts: np.ndarray, similarity: float):
    """Fingerprint, name, size and prefix of the set of shingles: all from one pass over the words."""

    @F.pandas_udf("fp long, name binary, size int, prefix array<long>")
    def figures(texts: pd.Series) -> pd.DataFrame:
        fps, names, sizes, prefixes = [], [], [], []
        for t in texts:
            words = spans(t)
            some = shingle_set(words)
            fps.append(simhash(words))
            names.append(xxhash.xxh3_128_digest(some.tobytes()))
            sizes.append(len(some))
            prefixes.append(prefix(some, common, counts, similarity).view(np.int64))
        fp = np.array(fps, np.uint64).view(np.int64)
        return pd.DataFrame({"fp": fp, "name": names, "size": np.array(sizes, np.int32), "prefix": pd.Series(prefixes, dtype=object)})

    return figures


def _set_udf():
    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(spans(t)).view(np.int64) for t in texts], dtype=object)

    return sets


def common_shingles(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the shingles that repeat in a sample of SAMPLE documents; at most RANKED."""
    parts = max(1, docs.count() // SAMPLE)
    some = docs.select(F.col(text).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0)
    each = some.select(F.explode(_set_udf()("text")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).filter("n > 2")
    rows = each.orderBy(F.desc("n"), "k").limit(RANKED).collect()
    hashes, counts = np.array([r["k"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    return docs.select(key, _fp_udf(width, seed)(F.col(text)).alias("fp"))


def links(classes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within distance.
    Under a crowded key not all pairs are given; the linear way for those holds for a distance of 2."""
    if distance != 2:
        raise ValueError("the exact way for crowded keys is built for a distance of 2")
    bits = 64 // blocks
    masks = [sum((1 << bits) - 1 << bits * i for i in kept) for kept in combinations(range(blocks), blocks - distance)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    filed = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for t, m in enumerate(masks)))
    posts = classes.select("fp", F.explode(filed).alias("k")).select("k.*", "fp")
    sizes = posts.groupBy("t", "block").agg(F.count("*").alias("n")).filter("n > 1")
    posts = materialise(posts.join(sizes, ["t", "block"]), "simhash-blocks")
    few = posts.filter(F.col("n") <= bucket).drop("n")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    pairs = few.join(few.withColumnRenamed("fp", "b"), ["t", "block"]).filter((F.col("fp") < F.col("b")) & close).select(F.col("fp").alias("a"), "b")
    crowd = posts.filter(F.col("n") > bucket)
    flips = {t: [signed(1 << i) for i in range(64) if not m >> i & 1] for t, m in enumerate(masks)}  # within a key only these bits differ
    flip = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(x) for x in xs)) for xs in flips.values())), F.col("t") + 1)
    near = crowd.select("t", "fp", F.explode(F.transform(flip, lambda x: F.col("fp").bitwiseXOR(x))).alias("value"))
    stars = near.groupBy("t", "value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = near.join(stars, ["t", "value"]).filter("fp <> a").select("a", F.col("fp").alias("b"))
    return materialise(pairs.unionByName(starred).distinct(), "simhash-links")


def _similar_udf(similarity: float):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        known = {}

        def shingles(text):
            if text not in known:
                if len(known) >= 256:
                    known.clear()
                known[text] = shingle_set(spans(text))
            return known[text]

        def test(x, y):
            common = len(np.intersect1d(x, y, assume_unique=True))
            return common >= similarity * (len(x) + len(y) - common)

        return pd.Series([test(shingles(x), shingles(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    return similar


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of uids whose texts (uid, text) have sets of shingles of that Jaccard similarity."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    texts = materialise(texts.join(needed, "uid", "left_semi"), "simhash-texts")
    side = lambda n: texts.select(F.col("uid").alias(n), F.col("text").alias(f"text_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    out = materialise(both.filter(_similar_udf(similarity)("text_a", "text_b")).select("a", "b"), "simhash-verified")
    release(texts)
    return out


def similar_links(sets: DataFrame, texts: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """Links (a, b) between the uid of distinct sets (uid, size, prefix) whose components are those of all pairs that
    are as similar; texts (uid, text) hold at least the text of each."""
    posts = sets.select("uid", "size", F.posexplode("prefix").alias("pos", "k")).select("uid", "size", (F.col("size") - F.col("pos")).alias("left"), "k")
    # counted by part of the key, which is less to shuffle; what is left of shingles that just share it goes below
    short = F.shiftright("k", 16).alias("short")
    shared = posts.groupBy(short).agg(F.count("*").alias("n"), F.min("size").alias("least")).filter("n > 1").select("short", "least")
    posts = posts.withColumn("short", short).join(shared, "short").withColumn("met", F.count("*").over(Window.partitionBy("uid")))  # of one set
    posts = posts.filter(_in_reach("left", "size", "least", similarity)).drop("short", "least")
    near = posts = materialise(posts, "simhash-posts")
    member = F.struct(F.xxhash64("uid").alias("h"), "uid", "size", "left", "met")
    nearest = F.struct((-F.col("left") / F.col("size")).alias("r"), member.alias("m"))
    centres = posts.groupBy("k").agg(F.count("*").alias("n"), F.min(nearest)["m"].alias("c0"), F.min(member).alias("c1"), F.max(member).alias("c2")).filter("n > 1")
    centres = centres.withColumn("c1", F.expr("if(c0.uid = c1.uid, c2, c1)"))  # two of them
    posts = materialise(posts.join(centres.select("k", "n", F.array("c0", "c1").alias("c")), "k"), "simhash-shared")
    release(near)
    met = posts.select("uid", "size", "left", "met", F.explode("c").alias("o")).filter("uid <> o.uid")
    met = met.filter(_in_reach(F.least("left", "o.left"), "size", "o.size", similarity) & _enough(F.least("met", "o.met"), ("size", "size"), ("o.size", "o.size"), similarity))
    met = materialise(met.select(F.least("uid", "o.uid").alias("a"), F.greatest("uid", "o.uid").alias("b")).distinct(), "simhash-met")
    found = verified(met, texts, similarity)
    crowded = posts  # kept until the last of it is read
    # with up to 3 members those were all pairs; of the others, the pairs across components
    roots = components(found).withColumnsRenamed({"node": "uid", "root": "_root"})
    recent = F.collect_list("k").over(Window.partitionBy("uid").orderBy(F.desc("left")).rowsBetween(-RECENT, -1))
    posts = posts.withColumn("recent", recent).filter("n > 3").drop("n", "c").join(roots, "uid", "left").withColumn("root", F.coalesce("_root", "uid")).drop("_root")
    several = posts.groupBy("k").agg(F.min("root").alias("m"), F.max("root").alias("x")).filter("m < x").select("k")
    posts = materialise(posts.join(several, "k"), "simhash-crowds")
    release(crowded)
    parts = posts.groupBy("k", "root").agg(F.min("size").alias("size"), F.max("size").alias("most"), F.max("left").alias("left"), F.max("met").alias("met"), F.count("*").alias("of"), F.min("recent").alias("recent"))
    side = lambda df, n: df.select("k", *(F.col(c).alias(f"{c}_{n}") for c in df.columns if c != "k"))
    possible = lambda most: _in_reach(F.least("left_a", "left_b"), "size_a", "size_b", similarity) & _enough(F.least("met_a", "met_b"), ("size_a", f"{most}_a"), ("size_b", f"{most}_b"), similarity)
    # a pair that has lately shared a shingle was met there
    new = ~F.arrays_overlap("recent_a", "recent_b")
    across = side(parts, "a").join(side(parts, "b"), "k").filter("of_a < of_b OR of_a = of_b AND root_a < root_b").filter(possible("most"))  # a: the smaller part
    across = across.filter(F.expr("of_b > 1") | new)
    across = across.select("k", "root_a", "root_b", *(F.col(f"{c}_b").alias(f"{c}_p") for c in ("left", "size", "most", "met")))  # of b's part
    near_p = _in_reach(F.least("left_a", "left_p"), "size_a", "size_p", similarity) & _enough(F.least("met_a", "met_p"), ("size_a", "size_a"), ("size_p", "most_p"), similarity)
    rest = across.join(side(posts, "a"), ["k", "root_a"]).filter(near_p)
    rest = rest.join(side(posts, "b"), ["k", "root_b"]).filter(possible("size")).filter(new)
    rest = rest.select(F.least("uid_a", "uid_b").alias("a"), F.greatest("uid_a", "uid_b").alias("b")).distinct().join(met, ["a", "b"], "left_anti")
    found = materialise(found.unionByName(verified(materialise(rest, "simhash-rest"), texts, similarity)), "simhash-similar")
    release(posts, met)
    return found


def _in_reach(left: Column | str, size_a: str, size_b: str, similarity: float) -> Column:
    """Whether sets of these sizes with at most `left` shingles in common can be as similar."""
    return (F.col(left) if isinstance(left, str) else left) * (1 + similarity) >= similarity * (F.col(size_a) + F.col(size_b)) - 1e-6


def _enough(met: Column, a: tuple[str, str], b: tuple[str, str], similarity: float) -> Column:
    """Whether sets of sizes between these bounds can be as similar if they share at most `met` shingles of their
    prefixes. With o in common, all but size - o of the first shingles of a set are, and its prefix is as long as the
    larger set allows, so they share at least o - similarity * size of it."""
    o = similarity / (1 + similarity) * (F.col(a[0]) + F.col(b[0]))
    return met >= o - similarity * F.greatest(a[1], b[1]) - 1e-6


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialise(edges, "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialise(small.filter("u <> v").distinct(), "components")
        state = edges.agg(F.count("*"), F.count_distinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before and state[0] == state[1]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state


def _grouped(fps: DataFrame, found: DataFrame, first: Column) -> DataFrame:
    """(fp, root, first) for each fp of fps, with links found besides those by bits; first is an aggregate over a component."""
    classes = materialise(fps.groupBy("fp").agg(first.alias("first")), "simhash-classes")
    near = links(classes.select("fp"))
    roots = components(near if found is None else near.unionByName(found))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "simhash-named")
    firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    return materialise(named.select("fp", "root").join(firsts, "root"), "simhash-ids")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per document: key, fp, component_id (the smallest key that links reach)."""
    marked = materialise(fingerprints(docs, key, text, width, seed), "simhash")
    ids = _grouped(marked, None, F.min(key))
    return marked.join(ids.withColumnRenamed("first", "component_id"), "fp").select(key, "fp", "component_id")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(row, key, uid, fp) for each row of docs, held as a struct, and (fp, root, first): first is the struct (unnamed,
    key, uid) of the first row of the component. Links by bits and by similarity count."""
    named = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))
    marked = named.select("row", "key", "uid", _figures_udf(*common_shingles(docs, text), similarity)("text").alias("f"))
    marked = materialise(marked.select("row", "key", "uid", "f.*"), "simhash")
    # one text of each set; the fingerprints that texts of one set have are linked
    sets = marked.filter("size > 0").groupBy("name").agg(F.min(F.struct("uid", "fp", "size", "prefix")).alias("one"))
    sets = materialise(sets.select("name", "one.*"), "simhash-sets")
    same = marked.select("name", F.col("fp").alias("b")).distinct().join(sets.select("name", F.col("fp").alias("a")), "name").filter("a <> b").select("a", "b")
    found = similar_links(sets.select("uid", "size", "prefix"), marked.select("uid", F.col(f"row.`{text}`").alias("text")), similarity)
    fp = lambda n: sets.select(F.col("uid").alias(n), F.col("fp").alias(f"fp_{n}"))
    found = found.join(fp("a"), "a").join(fp("b"), "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    found = materialise(found.unionByName(same).distinct(), "simhash-similar")
    release(sets)
    first = F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "uid"))
    return marked.select("row", "key", "uid", "fp"), _grouped(marked, found, first)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILAR) -> DataFrame:
    """docs with one row of each component."""
    marked, ids = groups(docs, key, text, similarity)
    kept = ids.select("first.uid").distinct()
    return marked.join(kept, "uid", "left_semi").select("row.*")
