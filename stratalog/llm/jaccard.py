"""Near-copies: SimHash over five-word shingles, then exact Jaccard similarity.

Each text's set of shingles has a wide SimHash fingerprint. Tiles of fingerprints are compared as in
``simhash``, with a radius that pairs of similarity 0.8 stay within, and the components of those
links hold every pair that may be similar. Inside each such component the similarity of all pairs
is then computed exactly, in tiles of bounded size: shingles that few texts hold add up pair by
pair, the others in a matrix product. What comes back of a tile is a spanning forest of the true
links, never the pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import release, written
from .components import connected_components
from .simhash import SEED, SHARE, WORDS, _forest, majority, wide_links

SHINGLE = 5
#: Shingles and texts of one side of an exact tile, about.
TILE_VALUES, TILE_TEXTS = 1 << 18, 1024
#: Shingles in at most so many texts of a tile are counted pair by pair.
FEW = 48
#: Values of a slice of the matrix product.
SLICE_VALUES = 1 << 20
SLICE = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Hashes(dict):
    """Hashes of words, remembered for a while."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles in order; a text of fewer words is one shingle, a text
    without a word has none. Words are between white space, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        h = _mixed(h * _MIX[0] + own[i : len(own) - k + 1 + i])
    return np.unique(h.view(np.int64))


def wide(own: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles, ``WORDS`` signed 64-bit words."""
    if not len(own):
        return np.zeros(WORDS, np.int64)
    seeds = np.arange(1, WORDS + 1, dtype=np.uint64) * _MIX[0]
    return majority(_mixed(own.view(np.uint64)[:, None] + seeds[None, :]))


def digest(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``."""
    n, m = len(a), len(b)
    out = np.zeros(n * m, np.int32)
    values = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(n + m), [len(x) for x in chain(a, b)])
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(values)])))
    inside = np.add.reduceat((owner < n).astype(np.int64), starts) if len(values) else sizes
    both = (inside > 0) & (inside < sizes)
    starts, sizes, inside = starts[both], sizes[both], inside[both]
    few = sizes <= FEW
    shapes = np.where(few, sizes * (FEW + 1) + inside, 0)
    pairs, held = [], 0
    for shape in np.unique(shapes[few]).tolist():
        s, k = divmod(shape, FEW + 1)
        at = starts[shapes == shape]
        rows = owner[at[:, None] + np.arange(k)[None, :]]
        cols = owner[at[:, None] + np.arange(k, s)[None, :]] - n
        pairs.append((rows[:, :, None] * m + cols[:, None, :]).ravel())
        held += len(pairs[-1])
        if held > SLICE_VALUES:
            out += np.bincount(np.concatenate(pairs), minlength=n * m).astype(np.int32)
            pairs, held = [], 0
    if pairs:
        out += np.bincount(np.concatenate(pairs), minlength=n * m).astype(np.int32)
    many = np.flatnonzero(~few)
    step = max(1, SLICE_VALUES // (n + m))
    for at in range(0, len(many), step):
        some = many[at : at + step]
        held = np.zeros((n + m, len(some)), np.float32)
        for col, (s, z) in enumerate(zip(starts[some].tolist(), sizes[some].tolist())):
            held[owner[s : s + z], col] = 1
        out += (held[:n] @ held[n:].T).astype(np.int32).ravel()  # sums of at most 2**20 ones are exact
    return out.reshape(n, m)


def similar(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs at ``SHARE`` or above, as numbers in ``a`` and ``b``."""
    shared = overlaps(a, b)
    union = np.array([len(x) for x in a], np.int32)[:, None] + np.array([len(x) for x in b], np.int32)[None, :] - shared
    return np.nonzero((shared * SHARE[1] >= union * SHARE[0]) & (shared > 0))


def _sets(docs: DataFrame) -> DataFrame:
    """``(key, node, size, w0 ...)``: of every row of ``docs(key, text)`` the digest, size and
    fingerprint of its set of shingles."""
    words = [f"w{i}" for i in range(WORDS)]
    names = ["key", "node", "size", *words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                found = [shingles(t) for t in rows.column("text").to_pylist()]
                bits = np.stack([wide(x) for x in found])
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array([digest(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), *(pa.array(bits[:, i]) for i in range(WORDS))], names=names)
        release()

    return docs.select("key", "text").mapInArrow(run, "key long, node long, size int, " + ", ".join(f"{w} long" for w in words))


def _verified(texts: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """``(u, v)``: forests of the pairs of ``texts(node, root, text)`` with one root that reach the similarity.

    ``plan(r, chunks)``: into how many chunks the texts of a root are cut; each pair of chunks is a
    task's group, and roots of one chunk are packed into ``buckets``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                sets = [shingles(t) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("root"), rows.column("chunks"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "root", "chunks", "own"])
        release()

    sets = texts.join(plan, F.col("root") == F.col("r")).select("node", "root", "chunks", "text").mapInArrow(cut, "node long, root long, chunks int, own array<long>")
    chunk = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    dealt = sets.select("node", "root", "own", "chunks", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    alone = F.col("chunks") == 1
    dealt = dealt.select(
        F.when(alone, F.pmod(F.xxhash64("root"), F.lit(buckets))).otherwise(F.col("root")).alias("r"),
        F.when(alone, -1).otherwise(F.least("chunk", "other")).alias("i"),
        F.when(alone, -1).otherwise(F.greatest("chunk", "other")).alias("j"),
        F.when(alone, -1).otherwise(F.col("chunk")).alias("side"), "node", "own")

    def compared(group: pa.Table) -> pa.Table:
        side, node = group.column("side").to_numpy(), group.column("node").to_numpy()
        own = [x.values.to_numpy() for x in group.column("own")]
        low, high = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
        i, j = similar([own[k] for k in a], [own[k] for k in b])
        u, v = _forest(i, j + len(a), len(a) + len(b)) if len(i) else (i, j)
        nodes = np.concatenate((node[a], node[b]))
        return pa.table({"u": pa.array(nodes[u], pa.int64()), "v": pa.array(nodes[v], pa.int64())})

    return dealt.groupBy("r", "i", "j").applyInArrow(compared, "u long, v long").where("u <> v").distinct()


def without_copies(docs: DataFrame, tile_values: int = TILE_VALUES, tile_texts: int = TILE_TEXTS) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, one of each group of near copies.

    A group is what links of five-word Jaccard similarity 0.8 or more reach; its row with the
    smallest id stays, a null id being the largest, and of rows that repeat id and text any one.
    Texts without a word are copies of nothing and all stay. Whole texts count, of any length. An
    empty table gives an empty result. Texts and sets of shingles are told apart by 64-bit digests.

    Texts are shuffled once, to mark those in a group; what follows sees only the marked ones.
    """
    names = docs.columns
    keyed = docs.withColumn("key", F.xxhash64("text"))
    own = written(_sets(keyed), "sets").where("size > 0")
    rest = ["size", *(f"w{i}" for i in range(WORDS))]
    nodes = written(own.groupBy("node").agg(F.count("*").alias("copies"), *(F.max(c).alias(c) for c in rest)), "nodes")
    near = connected_components(wide_links(nodes.select("node", *rest)))
    rooted = nodes.join(near, F.col("node") == F.col("u"), "left").select("node", "copies", "size", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    groups = rooted.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("texts"), F.sum("size").alias("total"))
    chunks = F.greatest(F.ceil(F.col("total") / tile_values), F.ceil(F.col("texts") / tile_texts)).cast("int")
    groups = written(groups.where("texts > 1").select("r", "texts", "total", chunks.alias("chunks")), "groups")
    joined = rooted.join(groups.select("r", F.lit(True).alias("paired")), F.col("root") == F.col("r"), "left")
    marks = joined.where("copies > 1 OR paired").select(F.col("node").alias("n"), "root", F.coalesce("paired", F.lit(False)).alias("paired"))
    marks = own.select("key", "node").distinct().join(marks, F.col("node") == F.col("n")).select(F.col("key").alias("k"), "node", "root", "paired")
    marked = keyed.join(marks, F.col("key") == F.col("k"), "left").drop("k", "key")
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(names)]
    marked = written(marked.select(*columns, "node", "root", "paired", F.monotonically_increasing_id().alias("row")), "marked")
    text, id_col = (f"c{names.index(c)}" for c in ("text", "doc_id"))
    whole = marked.where("paired").groupBy("node").agg(F.first("root").alias("root"), F.min(text).alias("text"))
    small = groups.where("chunks = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()
    buckets = max(1, -(-small[0] // tile_values), -(-small[1] // tile_texts))
    final = connected_components(_verified(whole, groups.select("r", "chunks"), buckets))
    best = marked.where("node is not null").select("node", "row", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row").alias("place"))
    best = best.join(final.toDF("u", "last"), F.col("node") == F.col("u"), "left").groupBy(F.coalesce("last", "node").alias("group")).agg(F.min("place").alias("place"))
    stay = written(best.select(F.col("place.row").alias("keep")), "stay")
    kept = marked.where("node is not null").join(stay, F.col("row") == F.col("keep"), "left_semi").unionByName(marked.where("node is null"))
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
