"""Language identification by the nearest of several centroids a language.

Texts become TF-IDF vectors of hashed letter bigrams and trigrams, normalised to length one. Each
language has up to ``CLUSTERS`` centroids from spherical k-means, and a text gets the language of
the centroid with the largest cosine. A text is rejected if that cosine is below what texts of its
length in the training sample reach; the bounds are fitted on pieces of many lengths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BITS = 12
DIM = 1 << BITS
CLUSTERS = 6
#: The model is fitted on a sample: of each language so many texts at most, and so many characters;
#: with many languages fewer texts, so that all together stay under ``SAMPLE_TOTAL``, but ``LEAST`` at least.
SAMPLE, SAMPLE_CHARS, SAMPLE_TOTAL, LEAST = 500, 1 << 22, 20_000, 12
#: Languages whose centroids a worker can hold; more are an error.
MAX_LANGUAGES = 4_000
#: What share of the sample's pieces of a length lies under the bound, and what part of the cosine there is the bound.
REJECT_SHARE = 0.002
REJECT_SCALE = 0.6
SLICE = 64
#: Characters of a text that are looked at together.
PORTION = 1 << 20

_LETTER = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x10000)), bool)
_WORD = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _WORD.finditer(text or ""))


def grams(text: str) -> np.ndarray:
    """The hashed bigrams and trigrams of a text's lower-cased letters; anything else is a gap of one."""
    out, text, gap = [], text.lower(), np.uint32(32)
    last = np.array([gap])  # what the portion before ends in
    for at in range(0, len(text), PORTION):
        codes = np.frombuffer(text[at : at + PORTION].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF), codes, gap)
        codes = np.concatenate((last, codes, np.array([gap][: at + PORTION >= len(text)], np.uint32)))
        codes = codes[np.concatenate(([True], (codes[1:] != gap) | (codes[:-1] != gap)))]
        a = codes * np.uint32(0x9E3779B1)
        b = a[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))
        c = b[:-1] ^ (codes[2:] * np.uint32(0xC2B2AE3D))
        for x in (b[len(last) - 1 :], c):
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            out.append(x >> np.uint32(32 - BITS))
        last = codes[-2:]
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def counts(texts: list[str]) -> np.ndarray:
    found = [grams(t) for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    return np.bincount(rows * DIM + np.concatenate(found), minlength=len(texts) * DIM).reshape(len(texts), DIM).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _length_bin(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(sizes, 1)).astype(int), 15)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # the language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    bounds: np.ndarray  # by the logarithm of the number of n-grams

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(tf) * self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and whether rejected, of texts that have letters."""
        tf = counts(texts)
        cosines = self.vectors(tf) @ self.centroids.T
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(texts)), best].astype(float), 0, 1)
        return [self.languages[self.owner[k]] for k in best], score, score < self.bounds[_length_bin(tf.sum(1))]


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; the first centres are the mean and then, each time, the farthest text."""
    centres = _unit(x.mean(0, keepdims=True))
    for _ in range(min(k, len(x)) - 1):
        centres = np.concatenate((centres, x[(x @ centres.T).max(1).argmin()][None]))
    for _ in range(rounds):
        near = (x @ centres.T).argmax(1)
        centres = _unit(np.stack([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def fit(texts: list[str], labels: list[str], clusters: int = CLUSTERS) -> Model:
    languages = sorted(set(labels))
    by: dict[str, list[str]] = {k: [] for k in languages}
    for t, v in zip(texts, labels):
        by[v].append(t)
    tfs = lambda own: np.concatenate([counts(own[i : i + SLICE]) for i in range(0, len(own), SLICE)])
    found = np.zeros(DIM)
    for k in languages:  # one language at a time is in memory
        found += (tfs(by[k]) > 0).sum(0)
    idf = np.log((1 + len(texts)) / (1 + found)).astype(np.float32) + 1
    centroids = [_clusters(_unit(np.log1p(tfs(by[k])) * idf), clusters) for k in languages]
    model = Model(languages, np.repeat(np.arange(len(languages)), [len(c) for c in centroids]), np.concatenate(centroids), idf, np.zeros(16))
    reached: list[list[float]] = [[] for _ in range(16)]
    for size in (1, 4, 16, 64, 256, 1 << 30):  # pieces of so many words
        pieces = []
        for i, t in enumerate(texts):
            words = t.split()
            at = (i * 7919) % max(1, len(words) - size + 1)
            pieces.append(" ".join(words[at : at + size]))
        pieces = [p for p in pieces if has_letter(p)]
        for i in range(0, len(pieces), SLICE):
            tf = counts(pieces[i : i + SLICE])
            for b, s in zip(_length_bin(tf.sum(1)), (model.vectors(tf) @ model.centroids.T).max(1)):
                reached[b].append(float(s))
    for b, scores in enumerate(reached):
        if len(scores) >= 50:
            model.bounds[b] = REJECT_SCALE * float(np.quantile(scores, REJECT_SHARE))
    return model


def learn(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, sample_total: int = SAMPLE_TOTAL) -> Model | None:
    """A model of every label, from a sample of the rows that ``learn_from`` admits and that have
    text and label, by a hash of id and text: of each label at most ``sample`` whole texts and
    ``sample_chars`` characters, one text at least. None if there is no such row; an error if there
    are more than ``MAX_LANGUAGES`` labels."""
    rows = docs.where(learn_from & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    each = max(LEAST, min(sample, sample_total // len(sizes)))
    # a first choice of somewhat more than is wanted, then the exact bounds over what is left
    part = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, float(min(1.0, (1.2 * each + 20) / n)))))
    spot = F.xxhash64(F.coalesce("id", F.lit("")), "text")
    few = rows.withColumn("spot", spot).where(F.pmod("spot", F.lit(1 << 20)) / float(1 << 20) < F.try_element_at(part, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("spot", "id", "text")
    placed = few.withColumns({"place": F.row_number().over(order), "chars": F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    picked = placed.where((F.col("place") <= each) & ((F.col("chars") <= sample_chars) | (F.col("place") == 1))).select("lang", "id", "text").collect()
    picked = sorted(picked, key=lambda r: (r["lang"], r["id"] or "", r["text"]))
    return fit([r["text"] for r in picked], [r["lang"] for r in picked])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, lang_pred, score, rejected, *keep)`` for every row, from the text alone.

    ``und`` with score 0, rejected, where a text is null or has no letter, and where there is no
    model. Whole texts count, of any length; rows that repeat an id or a text each keep their row; an
    empty table gives an empty result. The model is broadcast: six centroids of 4,096 floats a
    language, 100 KB, of ``MAX_LANGUAGES`` at most. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *(F.col(c).alias(n) for c, n in zip(keep, names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                texts = rows.column("text").to_pylist()
                usable = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                lang, score, gone = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if usable:
                    for i, v, s, r in zip(usable, *model.predict([texts[i] for i in usable])):
                        lang[i], score[i], gone[i] = v, float(s), bool(r)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gone, pa.bool_()), *([rows.column("text")] if keep else []), *(rows.column(n) for n in names)], names=["id", "lang_pred", "score", "rejected", *(["text"] if keep else []), *names])

    out = slim.select("id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), *(["text"] if keep else []), *names).schema
    found = slim.mapInArrow(run, out)
    return found.select(F.col("id").alias(id_col), "lang_pred", "score", "rejected", *([F.col("text").alias(text)] if keep else []), *(F.col(n).alias(c) for c, n in zip(keep, names)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
