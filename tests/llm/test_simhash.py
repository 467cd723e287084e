import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import simhash

SF = "/root/testdata/sf0.01"


def brute_roots(values, radius=3):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(int(values[i]) ^ int(values[j])).count("1") <= radius:
                a, b = root[i], root[j]
                if a != b:
                    root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def test_bucket_roots_match_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([70, 40, 40, 9, 2, 2])
    values = []
    for s in sizes:
        base = int(rng.integers(0, 1 << 62))
        for _ in range(s):
            v = base
            for b in rng.integers(0, 64, int(rng.integers(0, 7))):
                v ^= 1 << int(b)
            values.append(v)
    values = np.array(values, dtype=np.uint64)
    for radius in range(6):
        got, at = simhash.bucket_roots(values, sizes, radius), 0
        for s in sizes:
            assert (got[at : at + s] - at).tolist() == brute_roots(values[at : at + s], radius)
            at += s


def test_whole_table_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: simhash.simhash64(r.text) for r in rows}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    root = np.arange(len(ids))
    near = [(i, int(j)) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3) if j < i]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            m = min(root[i], root[j])
            if root[i] != m or root[j] != m:
                root[i] = root[j] = m
                changed = True
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        assert got[i] == (int(values[k].astype(np.int64)), ids[root[k]])


def test_parts_of_a_hot_bucket_lose_no_link(spark):
    base = 0x0123456789ABCDEF
    rows = [(base ^ (1 << a) ^ (1 << b),) for a in range(40) for b in range(a)]
    prints = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for (v,) in rows], "fp long").distinct()
    from strandloom.llm.components import connected_components

    out = connected_components(simhash.fingerprint_links(prints, part=64))
    assert out.select("root").distinct().count() == 1 and out.count() == prints.count()


def test_nulls_empties_repeats_and_clashing_names(spark):
    rows = [(3, None, "x"), (4, "", "x"), (4, "", "x"), (None, "", "x"), (5, "a b c d e", None), (6, "A b c  d e", "y"), (None, "a b c d e", "z"), (7, "only", "q"), (7, "only", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("key", F.lit(1)).withColumn("component_id", F.lit("c"))
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 3), (0, 5), (3, 3), (4, 3), (4, 3), (5, 5), (6, 5), (7, 7), (7, 7)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
