import random

import numpy as np

import corpus_pipeline
from stratalog.llm import jaccard
from stratalog.llm.simhash import wide_radius
from tests.llm.test_text import DOCS


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets, label = [plain(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        if sets[i]:
            best[find(i)] = min(best.get(find(i), (True, 0, "")), (d is None, d or 0, t))
    return sorted([(str(d), t) for i, (d, t) in enumerate(rows) if not sets[i]] + [(str(None if n else d), t) for n, d, t in best.values()], key=str)


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    line = draw(12)
    out = ["", None, "one", "One", "one two", "two one"]
    for n in (4, 5, 6, 20, 60, 60, 150, 150, 400, 400):
        base = draw(n) + (line if n > 20 else [])
        for edits in (0, 0, 1, 2, 3, 4, 6, 9):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return out


def test_stage_against_brute_force(spark, sf_dir, monkeypatch):
    rows = list(enumerate(texts())) + [(None, "one"), (3, " ".join(f"x{i}" for i in range(30)))]
    want = plain_kept(rows)
    assert 30 < len(want) < len(rows) - 30
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    found = corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()
    assert sorted(((str(r.doc_id), r.text) for r in found), key=str) == want
    assert jaccard.without_copies(df, tile_values=600, tile_texts=3).count() == len(want)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), sf_dir).count() == 0


def test_overlaps_in_both_ways(monkeypatch):
    rng = np.random.default_rng(3)
    draw = lambda n: [np.unique(rng.integers(0, 200, rng.integers(1, 80))) for _ in range(n)]
    a, b = draw(30), draw(40)
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    for few in (0, 5, 1000):
        monkeypatch.setattr(jaccard, "FEW", few)
        monkeypatch.setattr(jaccard, "SLICE_VALUES", 500)
        assert jaccard.overlaps(a, b).tolist() == want


def test_wide_radius_holds_similar_pairs():
    """Pairs at a similarity of exactly 0.8, of every small size and some large ones."""
    rng = np.random.default_rng(4)
    missed = tried = 0
    for size in (4, 5, 8, 12, 13, 16, 32, 36, 39, 40, 64, 400):
        for _ in range(120):
            x = rng.integers(-(1 << 62), 1 << 62, 2 * size)
            if size % 4 == 0:
                a, b = np.unique(x[:size]), np.unique(x[: size + size // 4])
            else:
                continue
            bits = int(np.bitwise_count((jaccard.wide(a) ^ jaccard.wide(b)).view(np.uint64)).sum())
            tried += 1
            missed += bits > wide_radius(np.array([size]))[0]
    assert tried > 900 and missed <= 2


def test_hub_of_a_group_whose_copies_are_apart(spark):
    """Copies that are each near one text, and further from each other, are one group."""
    base = [f"b{i}" for i in range(104)]
    rows = [(100, " ".join(base))]
    for k in range(60):
        own = list(base)
        own[k % 20 * 5] = f"x{k}"
        own[(k * 7 % 20) * 5 + 2] = f"y{k}"
        rows.append((k, " ".join(own)))
    want = plain_kept(rows)
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    got = sorted(((str(r.doc_id), r.text) for r in jaccard.without_copies(df, tile_values=900, tile_texts=7).collect()), key=str)
    assert got == want
