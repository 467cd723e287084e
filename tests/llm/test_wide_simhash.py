"""Wide SimHash classes against brute-force shingle similarities."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import simhash, wide_simhash

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def similar_pairs(rows, least):
    sets, holders, shared = {r.doc_id: shingles(r.text) for r in rows}, defaultdict(list), Counter()
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for ids in holders.values():
        shared.update(combinations(sorted(ids), 2))
    return {p: c / (len(sets[p[0]]) + len(sets[p[1]]) - c) for p, c in shared.items() if c / (len(sets[p[0]]) + len(sets[p[1]]) - c) >= least}


def test_pairs_at_four_fifths_are_found_and_others_left_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.component_id for r in wide_simhash.near_copies(docs).collect()}
    assert len(got) == len(rows)
    pairs = similar_pairs(rows, 0.65)
    near = [p for p, j in pairs.items() if j >= 0.8]
    assert near and all(got[a] == got[b] for a, b in near)
    linked = {i for p in pairs for i in p} | {r.doc_id for r in rows if not (r.text or "").split()}
    assert {i for i, c in got.items() if c != i} <= linked
    assert all(c <= i and got[c] == c for i, c in got.items())


def test_bits_follow_the_similarity():
    rng = np.random.default_rng(4)
    for similarity, links in ((0.95, 1.0), (0.9, 1.0), (0.6, 0.0), (0.3, 0.0)):
        own = round(400 * (1 - similarity) / (1 + similarity))
        close = 0
        for _ in range(20):
            h = rng.integers(0, 1 << 63, 400 + own, dtype=np.uint64)
            a, b = (wide_simhash.signature(x)[0] for x in (h[:400], h[own:]))
            close += (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count() <= wide_simhash.radius_of(0.8)
        assert abs(close / 20 - links) <= 0.05


def test_parts_of_a_hot_bucket_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base, rows = rng.integers(0, 1 << 63, 16, dtype=np.uint64), []
    for i in range(300):
        near = base.copy()
        near[i % 16] ^= np.uint64(1 << (i % 60))
        rows.append((i, bytearray(near.tobytes()), 7))
    keyed = spark.createDataFrame(rows, "node long, fp binary, key long")
    from strandloom.llm.components import connected_components

    out = connected_components(simhash.compare_buckets(keyed, 2, part=64, chunk=32))
    assert out.count() == 300 and out.select("root").distinct().count() == 1


def test_nulls_empties_repeats_short_texts_and_clashing_names(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(3, None), (4, ""), (4, ""), (None, " \n"), (5, "a b c"), (6, "A b  c"), (7, "a b d"), (None, "a b c"), (8, long), (8, long), (9, long + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("fp", "bands", "node", "key", "s", "text_key"):
        docs = docs.withColumn(name, F.lit("c"))
    got = sorted((r.doc_id or 0, r.component_id) for r in wide_simhash.near_copies(docs).collect())
    assert got == [(0, 3), (0, 5), (3, 3), (4, 3), (4, 3), (5, 5), (6, 5), (7, 7), (8, 8), (8, 8), (9, 8)]
    kept = simhash.keep_one(docs, classes=wide_simhash.near_copies)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 7, 8]
    assert wide_simhash.near_copies(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0), classes=wide_simhash.near_copies).count() == 0


def numbered(*runs):
    return " ".join(f"w{k}" for a, b in runs for k in range(a, b))


def test_links_are_exact_similarities(spark):
    texts = {
        1: numbered((0, 8)), 2: numbered((0, 9)),  # 4 of 5 shingles
        3: numbered((100, 116)), 4: numbered((100, 119)),  # 12 of 15
        5: numbered((200, 210)), 6: numbered((200, 211)),  # 6 of 7
        7: numbered((300, 307)), 8: numbered((300, 308)),  # 3 of 4: apart
    }
    for k in range(60):  # 296 shared shingles, 50 own: 0.747 between any two
        texts[100 + k] = numbered((1000, 1300), (10_000 + 100 * k, 10_050 + 100 * k))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in wide_simhash.near_copies(docs).collect()}
    assert got == {i: {2: 1, 4: 3, 6: 5}.get(i, i) for i in texts}


def test_classes_are_those_of_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        words = [f"t{k}" for k in range(60 + 40 * (i % 4))]
        at = rng.integers(0, len(words), int(rng.integers(0, 4)))
        for k in at:
            words[k] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    least = {i: i for i, _ in rows}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in similar_pairs(docs.collect(), 0.8):
        a, b = sorted((top(a), top(b)))
        least[b] = a
    assert {r.doc_id: r.component_id for r in wide_simhash.near_copies(docs).collect()} == {i: top(i) for i in least}


def test_parts_of_a_large_class_lose_no_link(spark):
    sets = [(i, np.arange(i, i + 40, dtype="<u8")) for i in range(0, 300, 2)]  # a chain: neighbours share 38 of 42
    rows = [(i, bytearray(wide_simhash.signature(wide_simhash._mix(h))[0]), bytearray(h.tobytes())) for i, h in sets]
    table = spark.createDataFrame(rows, "node long, fp binary, hashes binary")
    candidates = table.select("node", F.lit(0).cast("long").alias("root"))
    from strandloom.llm.components import connected_components

    for part in (16, 512):
        out = connected_components(wide_simhash.confirmed_links(candidates, table, 0.8, part))
        assert out.count() == 150 and out.select("root").distinct().count() == 1
