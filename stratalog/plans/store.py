"""The store: a live tier that ingest appends to, and an archive of immutable partitions.

A version of the store is one manifest file, ``manifest/N.json``, that lists the folders of every
relation: archived and live entries and raw rows, the template dimension, the parts of the plan
dimension. Folders are written under fresh names and never changed; a write counts from the moment its
manifest is renamed into place, all of it at once. A writer that fails before that leaves the store as
it was, and readers keep the version they began with. Every relation is read as archive plus live.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import masking
from ..operators import learner
from ..operators.ingest import Ingested, counted, ingest, numbered
from ..schema import ENTRIES, PLANS, RAWS, TEMPLATES
from ..ship import ship
from ..work import written

_SCHEMAS = {"entries": ENTRIES, "raws": RAWS, "templates": TEMPLATES, "plans": PLANS}
#: Relations that every batch reads whole, with their keys.
_DIMENSIONS = {"templates": "template_id", "plans": "source_pattern"}
#: Versions that readers may still be reading.
_KEEP_VERSIONS = 2
_LIVE = {"compression": "zstd"}
_ARCHIVE = {"compression": "zstd", "parquet.compression.codec.zstd.level": "12"}


class Conflict(RuntimeError):
    """Another writer has made the next version."""


@dataclass(frozen=True)
class Manifest:
    """A version: folders by relation and tier, the next ids, and what has been ingested."""

    version: int = 0
    archive: dict[str, list[str]] = field(default_factory=lambda: {"entries": [], "raws": []})
    live: dict[str, list[str]] = field(default_factory=lambda: {"entries": [], "raws": []})
    templates: list[str] = field(default_factory=list)
    plans: list[str] = field(default_factory=list)
    next_entry: int = 1
    next_log: int = 1
    labels: list[str] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {f for tier in (self.archive, self.live) for fs in tier.values() for f in fs} | {*self.templates, *self.plans}


class Store:
    """A folder on any file system that Spark writes to; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = ship(spark), path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._paths = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions

    def _versions(self) -> list[int]:
        at = self._paths(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest_path(self, version: int):
        return self._paths(f"{self.path}/manifest/{version:012d}.json")

    def _load(self, version: int) -> Manifest:
        stream = self._fs.open(self._manifest_path(version))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def manifest(self) -> Manifest:
        """The current version."""
        versions = self._versions()
        return self._load(versions[-1]) if versions else Manifest()

    def _commit(self, after: Manifest) -> Manifest:
        """Make ``after`` the version that follows the one it was made of; then drop what only versions before the last two hold."""
        after = replace(after, version=after.version + 1)
        final, draft = self._manifest_path(after.version), self._paths(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(asdict(after)).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {after.version} is there already")
        old = self._versions()[:-_KEEP_VERSIONS]
        if old:
            kept = set().union(*(self._load(v).folders() for v in self._versions()[-_KEEP_VERSIONS:]))
            gone = set().union(*(self._load(v).folders() for v in old)) - kept
            for folder in gone:
                self._fs.delete(self._paths(f"{self.path}/{folder}"), True)
            for v in old:
                self._fs.delete(self._manifest_path(v), False)
        return after

    def _sweep(self) -> None:
        """Delete folders that writers left which never came to a version."""
        known = set().union(*(self._load(v).folders() for v in self._versions()))
        for name in _SCHEMAS:
            at = self._paths(f"{self.path}/data/{name}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else ():
                if f"data/{name}/{s.getPath().getName()}" not in known:
                    self._fs.delete(s.getPath(), True)

    def _put(self, name: str, df: DataFrame, options: dict[str, str] | None = None) -> tuple[list[str], int]:
        """Write rows to a fresh folder: the folder, unless there are no rows, and how many there are."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        if name in _DIMENSIONS:  # few files while it is small, and no one task for all of it when it is not
            df = df.repartition(_DIMENSIONS[name])
        df.write.options(**(options or _LIVE)).parquet(f"{self.path}/{folder}")
        n = self._read(name, [folder]).count()
        return ([folder] if n else []), n

    # -- relations

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(_SCHEMAS[name])
        return reader.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], _SCHEMAS[name])

    def dimension(self, name: str) -> DataFrame:
        """The current version of a dimension."""
        found = self._read(name, getattr(self.manifest(), name))
        return found.dropDuplicates(["source_pattern"]) if name == "plans" else found

    def templates(self) -> DataFrame:
        return self.dimension("templates")

    def tier(self, tier: str, name: str) -> DataFrame:
        return self._read(name, getattr(self.manifest(), tier)[name])

    def _both(self, name: str) -> DataFrame:
        m = self.manifest()
        return self._read(name, m.archive[name] + m.live[name])

    def entries(self) -> DataFrame:
        return self._both("entries")

    def raws(self) -> DataFrame:
        return self._both("raws")

    def register_views(self, prefix: str = "") -> None:
        self.templates().createOrReplaceTempView(f"{prefix}templates")
        self.entries().createOrReplaceTempView(f"{prefix}log_entries")
        self.raws().createOrReplaceTempView(f"{prefix}raw_logs")

    # -- writing

    def done(self, label: str | None = None, stream: tuple[str, int] | None = None) -> bool:
        """Whether a batch is in the store: by its label, or as a number of a stream."""
        m = self.manifest()
        return label is not None and label in m.labels or stream is not None and m.streams.get(stream[0], -1) >= stream[1]

    def mark(self, stream: tuple[str, int]) -> None:
        """Note that all of a stream's batch is in the store; the labels of its parts are forgotten."""
        m = self.manifest()
        labels = [x for x in m.labels if not x.startswith(f"{stream[0]}-{stream[1]}/")]
        self._commit(replace(m, streams=m.streams | {stream[0]: stream[1]}, labels=labels))

    def ingest(self, groups: DataFrame, label: str | None = None, now_ms: int | None = None, stream: tuple[str, int] | None = None, **options) -> Ingested | None:
        """Ingest groups and append the result, all at once. A batch that is in the store already, by
        its label or its number in a stream, is not ingested again, and gives None."""
        m = self.manifest()
        if self.done(label, stream):
            return None
        now = int(time.time() * 1000) if now_ms is None else now_ms
        batch = ingest(groups, self._read("templates", m.templates), self.dimension("plans"), m.next_entry, m.next_log, now, **options)
        entries, n = self._put("entries", batch.entries)
        raws, k = self._put("raws", batch.raws) if batch.rows.count() > n else ([], 0)
        templates, _ = self._put("templates", counted(batch.templates, self._read("entries", entries), now))
        plans, _ = self._put("plans", batch.plans)
        live = {"entries": m.live["entries"] + entries, "raws": m.live["raws"] + raws}
        streams = m.streams | ({stream[0]: stream[1]} if stream else {})
        labels = m.labels + [label] if label is not None else m.labels
        self._commit(replace(m, live=live, templates=templates, plans=m.plans + plans, next_entry=m.next_entry + n, next_log=m.next_log + k, labels=labels, streams=streams))
        return batch

    # -- maintenance

    def relearn(self, max_branching: int = learner.MAX_BRANCHING) -> dict[str, int]:
        """Learn over the templates that are their own pattern. Templates without archived entries
        fold into the merged one, their live entries are rewritten; those with archived entries
        stay, and only later lines go to the merged one. Running it again changes nothing."""
        m = self.manifest()
        templates = self._read("templates", m.templates)
        # a template whose lines are already sent on to another one is not learned from again
        gone = self.dimension("plans").select(F.col("source_pattern").alias("pattern"))
        identity = templates.where(~F.contains("pattern", F.lit(learner.VAR))).join(gone, "pattern", "left_anti")
        found = written(learner.plans(identity.select("pattern"), max_branching), "relearn-plans")
        if found.isEmpty():
            return {"merged": 0, "folded": 0, "remapped": 0}
        archived = self._read("entries", m.archive["entries"]).select("template_id").distinct().withColumn("archived", F.lit(True))
        sources = found.join(templates.select(F.col("template_id").alias("source_id"), F.col("pattern").alias("source_pattern"), "occurrences", "created_at"), "source_pattern").join(archived.withColumnRenamed("template_id", "source_id"), "source_id", "left")
        sources = written(sources.withColumn("fold", F.col("archived").isNull()), "relearn-sources")
        last = templates.agg(F.max("template_id")).first()[0]
        target = sources.groupBy("final_pattern").agg(F.min("source_id").alias("first"), F.sum(F.when(F.col("fold"), F.col("occurrences")).otherwise(0)).alias("occurrences"), F.min("created_at").alias("created_at"))
        known = templates.select(F.col("template_id").alias("known_id"), F.col("pattern").alias("final_pattern"))
        target = numbered(target.withColumns({"source": F.lit(""), "seq": F.col("first")}), "new_id", last + 1)
        target = target.join(known, "final_pattern", "left").withColumn("template_id", F.coalesce("known_id", "new_id"))
        target = written(target, "relearn-targets")
        merged = target.where("known_id is null").select("template_id", F.col("final_pattern").alias("pattern"), "occurrences", "created_at", F.current_timestamp().alias("updated_at"))
        more = target.where("known_id is not null").select("template_id", F.col("occurrences").alias("more"))
        folded = sources.where("fold").select(F.col("source_id").alias("template_id"))
        kept = templates.join(folded, "template_id", "left_anti").join(more, "template_id", "left").withColumn("occurrences", F.col("occurrences") + F.coalesce("more", F.lit(0))).drop("more")
        moves = learner.with_programs(sources.where("fold").select("source_pattern", "final_pattern", "source_id")).join(target.select("final_pattern", "template_id"), "final_pattern").select("source_id", F.col("template_id").alias("to_id"), "program")
        live = self._read("entries", m.live["entries"]).join(moves, F.col("template_id") == F.col("source_id"), "left")
        live = live.select("entry_id", F.coalesce("to_id", "template_id").alias("template_id"), "log_timestamp", F.when(F.col("to_id").isNotNull(), learner.final_params(F.col("program"), F.col("params"))).otherwise(F.col("params")).alias("params"), "continuation_text")
        entries, _ = self._put("entries", live)
        after, _ = self._put("templates", kept.unionByName(merged))
        plans, _ = self._put("plans", found.select("source_pattern", "final_pattern"))
        self._commit(replace(m, live=m.live | {"entries": entries}, templates=after, plans=m.plans + plans))
        counts = sources.agg(F.countDistinct("final_pattern"), F.count_if("fold"), F.count_if(~F.col("fold"))).first()
        return {"merged": counts[0], "folded": counts[1], "remapped": counts[2]}

    def compact(self, relearn: bool = True) -> bool:
        """Move the live tail to new archive partitions, sorted so that row groups prune by template
        and time, and make one part of the plans. False if there is nothing to move."""
        if not any(self.manifest().live.values()):
            return False
        if relearn:
            self.relearn()
        m = self.manifest()
        tail = self._read("entries", m.live["entries"]).repartitionByRange("template_id", "log_timestamp").sortWithinPartitions("template_id", "log_timestamp", "entry_id")
        entries, _ = self._put("entries", tail, _ARCHIVE)
        raws, _ = self._put("raws", self._read("raws", m.live["raws"]).sortWithinPartitions("log_timestamp", "log_id"), _ARCHIVE)
        plans = self._put("plans", self.dimension("plans"))[0] if len(m.plans) > 1 else m.plans
        archive = {"entries": m.archive["entries"] + entries, "raws": m.archive["raws"] + raws}
        self._commit(replace(m, archive=archive, live={"entries": [], "raws": []}, plans=plans))
        self._sweep()
        return True

    def clear(self) -> None:
        self._fs.delete(self._paths(self.path), True)

    def size_bytes(self) -> int:
        """Bytes of the current version's files."""
        return sum(self._fs.getContentSummary(self._paths(f"{self.path}/{f}")).getLength() for f in self.manifest().folders())


def reconstructed(entries: DataFrame, templates: DataFrame) -> DataFrame:
    """Entries with their lines; entries whose template is missing drop out. Spark broadcasts
    the dimension where its measured size allows."""
    literal = templates.select("template_id", "pattern", masking.literals(F.col("pattern")).alias("literals"))
    joined = entries.join(literal, "template_id")
    return joined.withColumn("line", masking.with_continuation(masking.fill(F.col("literals"), F.col("params")), F.col("continuation_text"))).drop("literals")
