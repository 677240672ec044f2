"""Benchmark decontamination by edit distance over words.

A benchmark item leaks into a document if some stretch of the document is within ``MAX_EDITS`` of
the item's words in edit distance. By the pigeonhole principle such a stretch shares a run of words
with the item, which gives, without loss, the places where windows of the item's size are worth a
look: from the run to the farther end of the item. The CGK embedding walks along a window's words
and repeats a word for as long as a random bit of (step, word) is 0; two walks over similar words
fall into step again after an edit, so edit distance becomes Hamming distance between the walks.
Bit-sampling LSH compares a few sampled steps of both walks, in as many tables as simulated edits
(at random places, at the head, at the tail, evenly spread) need for the target recall; items of a
size for which no number of tables does are verified wherever they share a run. Every candidate is
verified by exact edit distance over the whole item.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import written

#: Similarity 0.8: at most this share of an item's words is edited.
MAX_EDITS = 0.2
RECALL = 0.99
#: Independent embeddings, steps sampled for a table, tables at most, and trials for each size of
#: item and place of edits.
WALKS = 8
SAMPLED = 2
MAX_TABLES = 256
TRIALS = 100
#: Words of a window at most, beside the shared run, and at least for its steps to tell anything.
WINDOW, LEAST_WINDOW = 120, 6
#: Benchmarks are handled in blocks of about so many characters; a worker's index of one takes some hundred times that at most.
BLOCK_CHARS = 1 << 20
#: Texts are searched so many characters at a time, and pairs of a place and an item so many at a time.
SLICE_CHARS = 1 << 20
PAIRS = 1 << 16
SEED = 20240607

#: Letters of scripts that are written without spaces are words of their own.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W_{_UNSPACED}]+|[{_UNSPACED}]")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_PAD, _GAP = np.uint32(0xFFFFFFFF), np.uint32(0xFFFFFFFE)


def _folded(text: str | None) -> str:
    """Lower case, character by character, so that places stay what they are."""
    return (text or "").replace("\u0130", "i").lower()


def _pattern(folded: str) -> re.Pattern:
    return _ASCII_WORD if folded.isascii() else _WORD


def words(text: str | None) -> list[str]:
    folded = _folded(text)
    return _pattern(folded).findall(folded)


def word_spans(text: str | None) -> list[tuple[int, int]]:
    """Where the words are, in characters of the text itself."""
    folded = _folded(text)
    return [m.span() for m in _pattern(folded).finditer(folded)]


def edits_allowed(n: int, share: float = MAX_EDITS) -> int:
    return int(n * share + 1e-9)


def run_length(n: int, edits: int) -> int:
    """The longest run of untouched words that ``edits`` edits must leave in ``n`` words, up to 4."""
    return max(1, min(4, -(-(n - edits) // (edits + 1))))


def infix_distance(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any stretch of ``text`` and where the first such
    stretch ends, by bit-parallel dynamic programming."""
    m = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """``(distance, start, end)`` of the nearest stretch."""
    distance, end = infix_distance(pattern, text)
    _, back = infix_distance(pattern[::-1], text[:end][::-1])
    return distance, end - back, end


class Index:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]], share: float = MAX_EDITS, recall: float = RECALL, plan: tuple[int, frozenset[int]] | None = None):
        rng = np.random.default_rng(SEED)
        self.items = [(i, w, edits_allowed(len(w), share)) for i, t in items if (w := words(t))]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws, _ in self.items for w in ws}))}
        self.coded = [np.array([self.vocabulary[w] for w in ws], np.uint32) for _, ws, _ in self.items]
        self.sizes = np.array([len(c) for c in self.coded], np.int64)
        self.edits = np.array([e for _, _, e in self.items], np.int64)
        self.runs = np.array([run_length(n, e) for n, e in zip(self.sizes.tolist(), self.edits.tolist())], np.int64)
        self.turn = rng.integers(0, 1 << 62, (WALKS, 2 * WINDOW + 2, 2)).astype(np.uint64) | np.uint64(1)
        self.mix = rng.integers(0, 1 << 62, 4).astype(np.uint64) | np.uint64(1)
        self.spots = rng.random((MAX_TABLES, SAMPLED))
        self.factors = rng.integers(0, 1 << 62, (MAX_TABLES, SAMPLED)).astype(np.uint64) | np.uint64(1)
        # all items one after another, each between pads; an anchor is an item's run of words
        self.begins = np.cumsum([1, *(len(c) + 1 for c in self.coded)])[: len(self.coded)]
        self.codes = np.concatenate([np.array([_PAD]), *(x for c in self.coded for x in (c, np.array([_PAD])))]).astype(np.uint32)
        self.grams, anchors = {}, []
        for g in sorted(set(self.runs.tolist())):
            hashes, item, offset = [], [], []
            for k in np.flatnonzero(self.runs == g).tolist():
                h = self._grams(self.coded[k], g)
                hashes.append(h)
                item.append(np.full(len(h), k))
                offset.append(np.arange(len(h)))
            hashes, item, offset = np.concatenate(hashes), np.concatenate(item), np.concatenate(offset)
            order = np.argsort(hashes, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.grams[g] = (hashes[order], sum(len(x[0]) for x in anchors), bits)
            anchors.append((item[order], offset[order], np.full(len(order), g)))
        self.item, self.offset, self.run = (np.concatenate([x[i] for x in anchors]) if anchors else np.empty(0, np.int64) for i in range(3))
        after, before = self.sizes[self.item] - self.offset - self.run, self.offset
        self.back = before > after
        length = np.minimum(np.maximum(before, after), WINDOW)
        self.steps = np.where(length < LEAST_WINDOW, 0, np.minimum(length * 7 // 4, 2 * WINDOW) // 12 * 12)
        self.group = self.steps * 2 + self.back
        # until the tables are planned, as many as there may be
        self.tables, self.exact = MAX_TABLES, frozenset()
        if plan is None:
            self.keys = {}
            self.plan = self._planned(recall, rng)
        else:
            self.plan = plan
        self.tables, self.exact = self.plan
        self.always = (self.steps == 0) | np.isin(self._kind(self.sizes)[self.item], list(self.exact))
        self.keys = self._anchor_keys(np.arange(len(self.item)))

    @staticmethod
    def _kind(sizes: np.ndarray) -> np.ndarray:
        return (np.log2(np.maximum(sizes, 1)) * 2).astype(np.int64)

    def _grams(self, codes: np.ndarray, g: int) -> np.ndarray:
        n = len(codes) - g + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        x = codes.astype(np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(g):
            h = (h ^ x[i : i + n]) * self.mix[i]
            h ^= h >> np.uint64(29)
        return h * self.mix[3]

    def _walk(self, codes: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int, back: int) -> np.ndarray:
        """LSH keys (windows by tables) of the embeddings of the windows that begin at ``at``; a walk
        stays between ``low`` and ``high``, where there is no word."""
        sampled = (self.spots[: self.tables] * steps).astype(np.int64)
        keys = np.zeros((self.tables, len(at)), np.uint64)
        begin = np.clip(at, low, high)
        for walk in range(min(WALKS, self.tables)):  # tables take turns at the walks
            uses: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for t in range(walk, self.tables, WALKS):
                for i, j in enumerate(sampled[t].tolist()):
                    uses[j].append((t, i))
            at = begin
            for j in range(max(uses) + 1):
                word = codes[at].astype(np.uint64)
                for t, i in uses.get(j, ()):
                    keys[t] += (word + np.uint64(1)) * self.factors[t, i]
                turn = ((word * self.turn[walk, j, 0] + self.turn[walk, j, 1]) >> np.uint64(40) & np.uint64(1)).astype(np.int64)
                at = np.maximum(at - turn, low) if back else np.minimum(at + turn, high)
        return np.ascontiguousarray((keys >> np.uint64(32)).astype(np.uint32).T)

    def _anchor_keys(self, which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.item), self.tables), np.uint32)
        for group in np.unique(self.group[which]).tolist():
            steps, back = divmod(group, 2)
            some = which[self.group[which] == group]
            for at in range(0, len(some) if steps else 0, 1 << 16):
                a = some[at : at + (1 << 16)]
                first = self.begins[self.item[a]]
                start = first + self.offset[a] + (-1 if back else self.run[a])
                out[a] = self._walk(self.codes, start, first - 1, first + self.sizes[self.item[a]], steps, back)
        return out

    def _agreeing(self, codes: np.ndarray, place: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """Pairs (place of a run in ``codes``, anchor) by tables in which both windows have one key."""
        keys = self.keys if keys is None else keys
        out = np.zeros((len(place), self.tables), bool)
        for group in np.unique(self.group[anchor]).tolist():
            steps, back = divmod(group, 2)
            if not steps:
                continue
            some = np.flatnonzero(self.group[anchor] == group)
            # equal places and lengths of run are one window of the text
            start = place[some] + (-1 if back else self.run[anchor[some]])
            own, first, same = np.unique(start, return_index=True, return_inverse=True)
            found = self._walk(codes, own, low[some][first], high[some][first], steps, back)
            out[some] = found[same] == keys[anchor[some]]
        return out

    def _planned(self, recall: float, rng: np.random.Generator) -> tuple[int, frozenset[int]]:
        """How many tables simulated edits need, and the kinds of item that need more than there may be."""
        kinds, tables, exact = self._kind(self.sizes), 4, set()
        for kind in np.unique(kinds).tolist():
            members = np.flatnonzero(kinds == kind)
            trial = [int(members[r // 4 % len(members)]) for r in range(4 * TRIALS)]
            edited = [self._edited(k, r % 4, rng) for r, k in enumerate(trial)]
            codes = np.concatenate(edited)
            begins = np.concatenate(([0], np.cumsum([len(c) for c in edited])))
            place, anchor = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *self.places(codes)))
            own = np.searchsorted(begins, place, "right") - 1
            mine = self.item[anchor] == np.array(trial)[own]
            place, anchor, own = place[mine], anchor[mine], own[mine]
            hit = self._agreeing(codes, place, anchor, begins[own], begins[own + 1] - 1, self._anchor_keys(np.unique(anchor)))
            hit[self.steps[anchor] == 0] = True
            need = np.full(4 * TRIALS, MAX_TABLES + 1)
            np.minimum.at(need, own, np.where(hit.any(1), hit.argmax(1) + 1, MAX_TABLES + 1))
            # each place of edits must reach the recall by itself
            most = max(int(sorted(need[p::4])[min(TRIALS - 1, int(np.ceil(recall * TRIALS)))]) for p in range(4))
            if 2 * most > MAX_TABLES:  # twice as many, as the trials are few
                exact.add(kind)
            else:
                tables = max(tables, 2 * most)
        return tables, frozenset(exact)

    def _edited(self, k: int, where: int, rng: np.random.Generator) -> np.ndarray:
        """An item with as many edits as allowed: at random, at the head, at the tail, evenly spread."""
        c, e = self.coded[k].tolist(), int(self.edits[k])
        new = lambda: int(rng.integers(0, len(self.vocabulary) + 1))
        for i in range(e):
            n = len(c)
            at = (int(rng.integers(0, n)), i, n - 1 - i, (2 * i + 1) * n // (2 * e))[where]
            kind = int(rng.integers(0, 3))
            c[at : at + (kind != 1)] = [] if kind == 0 else [new()]
        around = [new() for _ in range(2 * WINDOW)]
        return np.array([_GAP, *around[:WINDOW], *c, *around[WINDOW:], _GAP], np.uint32)

    def places(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the text where an item's run of words stands, with the anchor; a run that many
        items have comes in several portions."""
        for g, (hashes, first, bits) in self.grams.items():
            h = self._grams(codes, g)
            maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            low = np.searchsorted(hashes, h[maybe], "left")
            many = np.searchsorted(hashes, h[maybe], "right") - low
            maybe, low, many = maybe[many > 0], low[many > 0], many[many > 0]
            ends = np.cumsum(many)
            for at in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
                row = np.searchsorted(ends, pair, "right")
                yield maybe[row], first + low[row] + pair - (ends[row] - many[row])

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """``(text number, item number, edits, first word, end word)`` of all leaks in some texts."""
        if not self.items:
            return []
        get = self.vocabulary.get
        coded = [np.array([get(w, 0) for w in words(t)], np.uint32) for t in texts]
        gap = np.array([_GAP])
        codes = np.concatenate([gap, *(x for c in coded for x in (c, gap))]).astype(np.uint32)
        begins = np.cumsum([1, *(len(c) + 1 for c in coded)])
        spots: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for place, anchor in self.places(codes):
            doc = np.searchsorted(begins, place, "right") - 1
            keep = self.always[anchor]
            ask = np.flatnonzero(~keep)
            if len(ask):
                keep[ask] = self._agreeing(codes, place[ask], anchor[ask], begins[doc[ask]] - 1, begins[doc[ask] + 1] - 1).any(1)
            start, item, doc = (place - self.offset[anchor])[keep], self.item[anchor][keep], doc[keep]
            order = np.lexsort((start, doc, item))
            start, item, doc = start[order], item[order], doc[order]
            edges = np.flatnonzero(np.concatenate(([True], (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])))) if len(item) else np.empty(0, np.int64)
            for x, y in zip(edges.tolist(), [*edges[1:].tolist(), len(item)]):
                spots[int(item[x]), int(doc[x])].append(np.unique(start[x:y]))
        out = []
        for (item, doc), starts in spots.items():
            length, edits = int(self.sizes[item]), int(self.edits[item])
            first, last = int(begins[doc]), int(begins[doc + 1]) - 1
            best = (1 << 30, 0, 0)
            regions: list[list[int]] = []
            for s in np.unique(np.concatenate(starts)).tolist():
                a, b = max(first, s - edits), min(last, s + length + edits)
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = max(b, regions[-1][1])
                else:
                    regions.append([a, b])
            pattern = self.coded[item].tolist()
            for a, b in regions:
                distance, i, j = best_match(pattern, codes[a:b].tolist())
                best = min(best, (distance, i + a - first, j + a - first))
            if best[0] <= edits:
                out.append((doc, item, *best))
        return sorted(out)


_indexes: dict[tuple, Index] = {}


def _index(items, share: float, recall: float, plan) -> Index:
    """The index of a block, built once a worker; the one before it goes."""
    key = (hash(items), share, recall, plan)
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(list(items), share, recall, plan)
    return _indexes[key]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, share: float, recall: float):
    """The benchmark's blocks one after another, each as what a worker needs to build its index."""
    spark = benchmark.sparkSession
    bench = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null and t is not null")
    bench = written(bench, "benchmark")
    chars = bench.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = -(-chars // BLOCK_CHARS)
    for block in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(blocks)) == block).collect()
        items = tuple(sorted((r["item_id"], r["t"]) for r in rows))
        shared = spark.sparkContext.broadcast((items, share, recall, Index(list(items), share, recall).plan))
        yield shared


def _sliced(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows so that a slice holds about ``SLICE_CHARS`` of text."""
    sizes = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE_CHARS, "right")) - 1)
        yield at, min(end, len(column))
        at = end


LEAKS = "item_id long, n_edits int, similarity double, start int, end int"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = MAX_EDITS, recall: float = RECALL) -> DataFrame:
    """``(id, item_id, n_edits, similarity, start, end)``: one row for each pair of a document row
    and an item that leaked into it, with the place of the nearest stretch, of equally near ones the
    first, in characters of the text.

    Words are runs of letters and digits, in lower case; in scripts without spaces each letter is a
    word. Null and empty texts have no words, nor have such items, which are in no text; items too
    short for an edit must stand in a text as they are. Items without an id are left out. Repeated
    items are each reported, repeated documents too. Whole documents are searched, however long. Other
    columns are not looked at. The benchmark is handled in blocks by a hash, as many as its measured
    size asks for: each is broadcast as its texts, of ``BLOCK_CHARS`` or about, workers make its
    index, and its leaks are written before the next begins. There is no shuffle. An empty
    benchmark or table leaves an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = slim.select("id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("n_edits"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("end")).schema
    parts = []
    for shared in _blocks(benchmark, item_id, item_text, share, recall):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(*shared.value)
            for batch in batches:
                for low, high in _sliced(batch.column("text")):
                    rows = batch.slice(low, high - low)
                    texts = rows.column("text").to_pylist()
                    found = index.search(texts)
                    if not found:
                        continue
                    spans = {d: word_spans(texts[d]) for d in {f[0] for f in found}}
                    columns = [
                        rows.column("id").take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([index.items[f[1]][0] for f in found], pa.int64()),
                        pa.array([f[2] for f in found], pa.int32()),
                        pa.array([1 - f[2] / len(index.items[f[1]][1]) for f in found], pa.float64()),
                        pa.array([spans[f[0]][f[3]][0] for f in found], pa.int32()),
                        pa.array([spans[f[0]][f[4] - 1][1] for f in found], pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "item_id", "n_edits", "similarity", "start", "end"])

        parts.append(written(slim.mapInArrow(run, schema), "leaks"))
        shared.unpersist()
    out = docs.sparkSession.createDataFrame([], schema) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = MAX_EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, told row by row, so that rows that share an
    id are each judged by their own text. One pass for each block, no shuffle."""
    out, names = docs, docs.columns
    at = names.index(text)
    for number, shared in enumerate(_blocks(benchmark, item_id, item_text, share, recall)):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(*shared.value)
            for batch in batches:
                for low, high in _sliced(batch.column(at)):
                    rows = batch.slice(low, high - low)
                    gone = {f[0] for f in index.search(rows.column(at).to_pylist())}
                    yield rows.filter(pa.array([i not in gone for i in range(rows.num_rows)], pa.bool_()))

        out = (written(out, "clean") if number else out).mapInArrow(run, docs.schema)
    return out
