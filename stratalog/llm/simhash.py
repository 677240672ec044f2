"""Near-duplicates by SimHash, compared exactly in tiles.

Fingerprints are reduced to the distinct ones first, so exact copies never meet. They are laid out
in cells by population counts: those of the four 16-bit parts of a 64-bit fingerprint, whose
differences sum up to a lower bound of the Hamming distance, or that of a wide fingerprint beside
the size of its text. Only cells within the radius of each other are compared, and all other tile
pairs are skipped without loss. Cells are cut into tiles of bounded size by hash. Pairs of tiles
are planned by their numbers, then the tiles are fetched, so a dense cell is many small tasks; a
tile pair is one numpy exclusive-or with a bit count, and gives back a spanning forest of its
links, never all the pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import release, written
from .components import connected_components

SEED = 42
RADIUS = 3
SHINGLE = 3
TILE = 4096
PARTS = 4

#: Wide fingerprints: words of 64 bits, and the radius that holds a pair of the similarity (as a
#: fraction of whole numbers). At a Jaccard similarity of 0.8 two texts differ in 0.15 of the bits on
#: average, short ones in up to 0.19; both radii lie four standard deviations above.
WORDS = 4
SHARE = (4, 5)
WIDE_RADIUS, SHORT_RADIUS, SHORT = 62, 74, 40
WIDE_TILE = 8192
#: Classes of text size for each factor of 5/4.
CLASSES = 2


def _starts(words: list[bytes], k: int) -> tuple[list[int], list[int]]:
    """Where each run of ``k`` words begins and ends in the words joined by spaces."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as a signed 64-bit number; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(*_starts(words, k))), np.uint64, len(words) - k + 1)
    return int(majority(hashes[:, None])[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each bit of rows of 64-bit words whether it is set in over half the rows."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536])
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text`` but with ``out``: a pass over the partitions, no shuffle."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).withColumn(out, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            fps: list[int] = []
            for at in range(0, len(column), 256):
                fps.extend(fingerprint(t, shingle) for t in column.slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps, pa.int64())], names=[*rest, out])

    return docs.select(*rest, text).mapInArrow(run, schema)


class Tile(NamedTuple):
    nodes: np.ndarray  # int64
    sizes: np.ndarray
    words: list[np.ndarray]  # uint64, one array for each 64 bits


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``n`` nodes reduced to (node, smallest node of its component) links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def compare(a: Tile, b: Tile, limit: np.ndarray, ratio: tuple[int, int] | None = None, rows: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles: pairs that differ in at most ``limit`` bits
    (by row of ``a``) and whose sizes, if there is a ratio, are within it."""
    nodes = np.concatenate((a.nodes, b.nodes))
    us, vs, held = [], [], 0
    for at in range(0, len(a.nodes), rows):
        d = None
        for x, y in zip(a.words, b.words):
            one = np.bitwise_count(x[at : at + rows, None] ^ y[None, :])
            d = one if d is None else d + one if len(a.words) < 4 else np.add(d, one, out=d)
        i, j = np.nonzero(d <= limit[at : at + rows, None])
        i += at
        if ratio is not None and len(i):
            n, m = a.sizes[i], b.sizes[j]
            near = (n * ratio[0] <= m * ratio[1]) & (m * ratio[0] <= n * ratio[1])
            i, j = i[near], j[near]
        us.append(i)
        vs.append(j + len(a.nodes))
        held += len(i)
        if held > 1_000_000:
            u, v = _forest(np.concatenate(us), np.concatenate(vs), len(nodes))
            us, vs, held = [u], [v], len(u)
    if not held:
        return nodes[:0], nodes[:0]
    u, v = _forest(np.concatenate(us), np.concatenate(vs), len(nodes))
    other = nodes[u] != nodes[v]
    return nodes[u][other], nodes[v][other]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of 64-bit fingerprints (int64 arrays)."""
    tiles = [Tile(x, x, [x.view(np.uint64)]) for x in (a, b)]
    return compare(*tiles, np.full(len(a), radius))


def _pairs(cells: DataFrame, tops: list[int], steps: list[tuple[int, ...]], tile: int, words: list[str]) -> DataFrame:
    """``(a, b)``: the tiles of each pair of tiles that may hold a link.

    ``cells`` holds each node once, with its place ``g0, g1, ...`` among the cells; cells a step of
    ``steps`` apart are compared, places run from 0 to ``tops``. First come the pairs of tile numbers, a few
    bytes each, then the tiles: no key has more rows than a tile has partners.
    """
    bases = [int(np.prod([t + 1 for t in tops[:i]])) for i in range(len(tops))]
    places = [f"g{i}" for i in range(len(tops))]
    cells = cells.withColumn("cell", sum((F.col(g) * F.lit(b) for g, b in zip(places, bases)), F.lit(0)).cast("long"))
    size = cells.groupBy("cell", *places).agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    size = written(size, "cells")
    own = size.select(F.col("cell").alias("c"), "chunks")
    tiles = cells.join(own, F.col("cell") == F.col("c")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    tiles = written(tiles.groupBy("cell", "chunk").agg(F.collect_list(F.struct("node", "size", *words)).alias("rows")), "tiles")
    near = F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(d)), F.lit(sum(x * b for x, b in zip(d, bases))).cast("long").alias("by")) for d in steps))
    inside = F.lit(True)
    for i, top in enumerate(tops):
        inside = inside & (F.col(f"g{i}") + F.col(f"s.d{i}")).between(0, top)
    home = size.select("cell", *places, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_a"))
    home = home.select("*", F.explode(near).alias("s")).where(inside).select("cell", "chunk_a", (F.col("cell") + F.col("s.by")).alias("k"))
    first = F.when(F.col("k") == F.col("cell"), F.col("chunk_a")).otherwise(0)
    ids = home.join(own, F.col("k") == F.col("c")).select("cell", "chunk_a", "k", F.explode(F.sequence(first, F.col("chunks") - 1)).alias("chunk_b"))
    a = tiles.select(F.col("cell").alias("ca"), F.col("chunk").alias("na"), F.col("rows").alias("a"))
    b = tiles.select(F.col("cell").alias("cb"), F.col("chunk").alias("nb"), F.col("rows").alias("b"))
    # many ids compress to little, which is no reason to broadcast them
    held = ids.hint("merge").join(a, (F.col("cell") == F.col("ca")) & (F.col("chunk_a") == F.col("na"))).select("a", "k", "chunk_b")
    return held.hint("merge").join(b, (F.col("k") == F.col("cb")) & (F.col("chunk_b") == F.col("nb"))).select("a", "b")


def _compared(pairs: DataFrame, radius, ratio: tuple[int, int] | None = None) -> DataFrame:
    """``(u, v)``: the links of all tile pairs, as forests. ``radius`` gives the limits by size."""

    def tile(rows) -> Tile:
        nodes, sizes, *words = (x.to_numpy(zero_copy_only=False) for x in rows.flatten())
        return Tile(nodes, sizes, [w.view(np.uint64) for w in words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i in range(batch.num_rows):
                a, b = (tile(batch.column(c)[i].values) for c in ("a", "b"))
                u, v = compare(a, b, radius(a.sizes), ratio)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (us, vs)], names=["u", "v"])
        release()

    return pairs.mapInArrow(run, "u long, v long").distinct()


def _half(steps) -> list[tuple[int, ...]]:
    """Each pair of opposite steps once."""
    return [d for d in steps if d >= (0,) * len(d)]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``fps(fp long)``, distinct, to ``(u, v)``: links whose components are those of all pairs
    of fingerprints at ``radius`` or fewer differing bits."""
    part = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int")
    cells = fps.select(F.col("fp").alias("node"), F.lit(0).alias("size"), F.col("fp").alias("w0"), *(part(i).alias(f"g{i}") for i in range(PARTS)))
    steps = _half(d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius)
    return _compared(_pairs(cells, [16] * PARTS, steps, tile, ["w0"]), lambda sizes: np.full(len(sizes), radius))


def wide_radius(sizes: np.ndarray) -> np.ndarray:
    return np.where(sizes < SHORT, SHORT_RADIUS, WIDE_RADIUS).astype(np.uint8)


def wide_links(nodes: DataFrame, tile: int = WIDE_TILE) -> DataFrame:
    """``nodes(node long, size int, w0 ... w3 long)``, distinct, to ``(u, v)``: links whose components
    are those of all pairs of wide fingerprints within the radius and of sizes within ``SHARE``.

    Cells go by population count, in bands wider than the radius, and by text size.
    """
    words = [f"w{i}" for i in range(WORDS)]
    band = max(WIDE_RADIUS, SHORT_RADIUS) + 1
    ones = sum((F.bit_count(w) for w in words), F.lit(0))
    tops = [64 * WORDS // band, 200 * CLASSES]
    step = float(np.log(SHARE[1] / SHARE[0]) / CLASSES)
    cells = nodes.select("node", "size", *words, F.floor(ones / band).cast("int").alias("g0"), F.least(F.floor(F.log(F.col("size").cast("double")) / step), F.lit(tops[1])).cast("int").alias("g1"))
    # a pair on the edge of the ratio may lie one class further apart by rounding
    steps = [d for d in product((-1, 0, 1), range(CLASSES + 2)) if d[1] or d[0] >= 0]
    return _compared(_pairs(cells, tops, steps, tile, words), wide_radius, SHARE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE, shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp long, component_id)`` for every row of ``docs``.

    A component is what links of ``radius`` or fewer differing bits reach; its id is its smallest
    document id. Texts that are null or without words have fingerprint zero and are linked like any
    other. Whole texts count, however long. Rows that repeat an id each keep their row; a null id counts for no component's id
    unless all are null, then the component id is null. Other columns, whatever their names, are
    not looked at. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    own = written(fingerprints(slim, shingle=shingle), "fingerprints")
    distinct = written(own.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    root = connected_components(links(distinct.select("fp"), radius, tile))
    rooted = distinct.join(root, F.col("fp") == F.col("u"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = written(rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("key"), "component_id"), "named")
    return own.join(named, F.col("fp") == F.col("key")).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
