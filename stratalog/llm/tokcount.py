"""Token counts through a digest cache.

The cache is a table ``(digest, n_tokens, tokenizer)``, partitioned by tokenizer, in the shared folder. Contents are joined to
it by digest under the tokenizer's own digest; one row of each content that is missing is encoded,
and the new counts are appended. Normalising a content means reading null as empty and text as
UTF-8: anything more could change the count.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bit_marks, may_hold, work_path, written
from .pretok import shared_file, splitter

#: Pieces whose counts are remembered; as many again stay as the older half.
MAX_PIECES = 150_000
LONG_PIECE = 64
SLICE = 64
#: The library makes an object with offsets for each piece, so it gets so many at a time.
CHUNK = 1024
CACHE = "digest binary, n_tokens long, tokenizer string"


class Counter(dict):
    """Counts tokens as the library does.

    Where a .json file splits text by the byte-level pattern and normalises nothing, pieces are
    independent, so the library encodes each piece once and its count is remembered; texts that
    hold an added token's string, and other kinds of file, are given to the library whole.
    """

    def __init__(self, name: str, data: bytes, pattern: str):
        self.library, self.split, self.added = None, None, None
        self.older: dict[str, int] = {}
        if name.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        elif name.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already; more threads only hold more memory
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_buffer(data)
            self.library.no_truncation()
            self.library.no_padding()
            spec = json.loads(data)
            before = spec.get("pre_tokenizer") or {}
            added = [t for t in spec.get("added_tokens") or []]
            if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and all(not t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
                self.split = splitter(pattern)
                self.added = re.compile("|".join(re.escape(t["content"]) for t in added)).search if added else None
        else:
            raise ValueError(f"a .json or .model file is needed, not {name}")

    def whole(self, texts: list[str]) -> list[int]:
        if self.library is None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        return [len(x) for at in range(0, len(texts), CHUNK) for x in self.library.encode_batch_fast(texts[at : at + CHUNK], add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if self.split is None:
            return self.whole(texts)
        odd = [self.added is not None and self.added(t) is not None for t in texts]
        split = [[] if o else self.split(t) for t, o in zip(texts, odd)]
        if len(self) >= MAX_PIECES:
            self.older = dict(self)
            self.clear()
        missing = set().union(*split).difference(self)
        back = missing.intersection(self.older)
        self.update((p, self.older[p]) for p in back)
        missing = list(missing - back)
        short = [p for p in missing if len(p) <= LONG_PIECE]
        self.update(zip(short, self.whole(short)))
        if len(short) < len(missing):
            long = [p for p in missing if len(p) > LONG_PIECE]
            known = dict(zip(long, self.whole(long)))
            return [self.whole([t])[0] if o else sum(self[p] if len(p) <= LONG_PIECE else known[p] for p in ps) for t, o, ps in zip(texts, odd, split)]
        return [self.whole([t])[0] if o else sum(map(self.__getitem__, ps)) for t, o, ps in zip(texts, odd, split)]


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, cache: str | None = None) -> DataFrame:
    """``(id, n_bytes long, n_tokens long, digest binary)`` for every row: whole texts, without
    begin, end or added special tokens, special strings as the library's default has them.

    ``cache``: path of the count table, a folder for each tokenizer; later calls find there what
    earlier ones have counted. By default each call has its own in the shared folder. A null text
    counts as empty. Of equal texts one is encoded; rows that repeat an id each keep their row, a
    null id too; other columns are not looked at. An empty table gives an empty result.

    Ids and digests are shuffled to find the misses. Texts whose digest nothing shares and that
    are not in the cache are encoded where they are; bitmaps of digests, 8 MB at most, are broadcast
    to tell them. The others are shuffled to find the one of each digest to encode; all
    joins on the digest are ones that adaptive execution can split.
    """
    import public_tokenizers

    spark = docs.sparkSession
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    shared, name = shared_file(spark, path), path.rsplit("/", 1)[-1]
    version = shared.value[0]
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = written(slim.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "keys")
    cache = cache or work_path(spark, "token-counts")
    put = lambda counts: counts.write.mode("append").partitionBy("tokenizer").parquet(cache)
    put(spark.createDataFrame([], CACHE))
    known = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _counters:
            _counters[version] = Counter(name, shared.value[1], pattern)
        counter = _counters[version]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                counts = counter.count(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array(counts, pa.int64()), pa.array([version] * len(counts), pa.string())], names=["digest", "n_tokens", "tokenizer"])

    held = keys.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    held = written(held.join(known().select("digest", F.lit(True).alias("cached")), "digest", "left"), "held")
    missing = held.where("cached IS NULL")
    if not missing.isEmpty():
        wanted = written(bit_marks(missing, "digest"), "marks")
        several = written(bit_marks(held.where("n > 1 OR cached"), "digest"), "marks")
        marked = may_hold(may_hold(slim, "digest", wanted, "wanted").where("wanted"), "digest", several, "several")
        own = missing.select(F.col("digest").alias("d"), "first")
        one = marked.where("several").select("digest", "text", "id").join(own, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("first")), "left_semi")
        alone = marked.where("NOT several").select("digest", "text")
        put(alone.unionByName(one.select("digest", "text")).mapInArrow(run, CACHE))
    counted = written(known(), "counts")  # so that the join below has no aggregate beside it, and hot digests can be split
    return keys.join(counted, "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "digest")
