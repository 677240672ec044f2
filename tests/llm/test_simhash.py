import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stratalog.llm import simhash
from stratalog.llm.components import connected_components

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    base = [" ".join(word() for _ in range(rng.choice((0, 1, 2, 3, 40, 300)))) for _ in range(40)]
    near = []
    for t in base:
        w = t.split()
        if len(w) > 30:
            w[rng.randrange(len(w))] = word()
        near.append(" ".join(w).upper() if rng.random() < 0.3 else "\t".join(w))
    return base + near + ["", None, "  \n", base[-1], base[-1]]


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], DOCS + ", fp string, component_id int")
    found = {r.doc_id: r for r in simhash.near_duplicates(df, tile=4).withColumn("hex", simhash.hex_fingerprint()).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    assert [found[i].hex for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert {i: r.component_id for i, r in found.items()} == plain_components([i for i, _ in rows], fps)


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (None, None)], DOCS)
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert rows == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_dense_groups_give_forests():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 62, 1, dtype=np.int64)
    near = centre ^ (np.int64(1) << rng.integers(0, 62, 500).astype(np.int64))
    u, v = simhash.tile_links(near, near)
    assert 0 < len(u) <= 1000 and set(v.tolist()) == {int(near[0])}


def test_components_of_a_chain(spark):
    n = 300
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (7, 7)], "u long, v long")
    found = {r.u: r.root for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(1, n)} | {1001: 1000, 1002: 1000}
    assert connected_components(edges.limit(0)).count() == 0


def test_skewed_tile_cells(spark):
    rng = np.random.default_rng(4)
    fps = np.unique(np.concatenate([rng.integers(-(1 << 62), 1 << 62, 300, dtype=np.int64), np.int64(255) ^ (np.int64(1) << np.arange(60, dtype=np.int64))]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    found = {r.u: r.root for r in connected_components(simhash.links(df, tile=16)).collect()}
    groups = plain_components([int(x) for x in fps], [int(x) & (1 << 64) - 1 for x in fps])
    assert {k: v for k, v in groups.items() if k != v} == found
    assert df.where(F.col("fp").isNull()).count() == 0


def test_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice(("alpha", "beta", "gamma", "delta", "eps")) + str(rng.randrange(50)) for _ in range(150_000))
    rows = [(1, long), (2, long.upper()), (3, long + " end"), (4, "short")]
    found = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert [found[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert found[1].fp & (1 << 64) - 1 == plain_fingerprint(long)
