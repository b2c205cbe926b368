"""A stream of changed files against a corpus that follows it: a log of bags with versions and tombstones.

The log is a folder. ``gen=n`` holds the corpus as it was after batch n (-1: at the start): the newest version of every
path, its bag, the features numbered by rarity, the bags packed in these numbers for the join, and the findings
among these versions. ``delta=k`` holds what batch k changed, and the numbers of features that are new in it. What a batch sees is merged when it is read: paths that
deltas have changed hide their rows in the generation, so the generation is neither shuffled nor written for a batch.
After ``every`` deltas the next batch first merges them into a new generation, whose rarity is counted anew; all bags
of a generation and its deltas are in the order of its rarity, and what it does not have is the rarest. Findings come from
the join of profiles in ``simjoin``: paths with equal bags are one, and only lists with a changed path are met.

Batch k reads generations and deltas of earlier batches only and writes its own delta anew, so a batch that runs again
after a failure changes nothing. A version that is not above its path's newest one comes late and is left out; of equal
versions in a batch a deletion counts, then the greater text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from structsim.operators import bags as B
from structsim.operators import simjoin as J
from structsim.sources.storage import stored

TABLES = {
    "heads": "path string, version long, deleted boolean",
    "bags": "path string, version long, feature string, cnt int",
    "packed": "path string, version long, fc long, fingerprint string, features array<bigint>, cnts array<int>",
    "rarity": "feature string, rank long",
    "findings": "left_path string, left_version long, right_path string, right_version long, score double",
}
#: Numbers that a delta's new features may take; far more than it has partitions, times the rows of each.
NEW = 1 << 50


def _names(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


def newest(changes: DataFrame) -> DataFrame:
    """The newest version of each path: path, version, text, deleted."""
    if "deleted" not in changes.columns:
        changes = changes.withColumn("deleted", F.lit(False))
    row = F.struct(F.col("version").cast("long").alias("version"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "text")
    return changes.where("path is not null and version is not null").groupBy("path").agg(F.max(row).alias("r")).select("path", "r.*")


def _bags(files: DataFrame) -> DataFrame:
    """(path, version, feature, cnt) of live files (path, version, text, deleted)."""
    own = B.word_bags(files.where("not deleted").withColumn("id", F.struct("path", "version")), "id")
    return own.select("fragment_id.*", "feature", "cnt")


def _packed(bags: DataFrame, ranks: DataFrame) -> DataFrame:
    """The bags in the numbers of ``ranks``, as arrays, and their identity."""
    entries = F.sort_array(F.collect_list(F.struct("rank", "cnt"))).alias("e")
    rows = bags.join(ranks, "feature").groupBy("path", "version").agg(F.sum("cnt").alias("fc"), entries)
    rows = rows.select("path", "version", "fc", F.col("e.rank").alias("features"), F.col("e.cnt").alias("cnts"))
    whole = F.concat_ws(";", *[F.array_join(F.col(c).cast("array<string>"), ",") for c in ("features", "cnts")])
    return rows.withColumn("fingerprint", F.sha2(whole, 256))


def _found(live: DataFrame, changed: DataFrame | None, threshold: float) -> DataFrame:
    """The similar pairs of ``live`` rows of "packed", with a changed path (path) on one side or both, if ``changed`` is given."""
    if changed is None:
        live = live.withColumn("focused", F.lit(True))
    else:
        live = live.join(changed.select("path", F.lit(True).alias("focused")), "path", "left").na.fill(False, ["focused"])
    live = stored(live, "live")
    constant = [F.lit("").alias(c) for c in ("domain", "kind", "family", "language")]
    files = live.select(F.col("path").alias("fragment_id"), "path", "version", "fingerprint", F.col("fc").alias("feature_count"), "focused", *constant)
    profs = stored(J.profiles(files), "profiles")
    own = live.select(F.col("path").alias("profile_id"), "features", "cnts")
    packed = stored(own.join(profs.select("profile_id", "part", "fc", "family", "language", "focused"), "profile_id"), "packed")
    only = changed is not None
    similar = stored(J.similar_packed(packed, profs, threshold, focused_only=only), "similar")
    pairs = J.listed_pairs(files, profs, similar, focused_only=only).select(F.col("left_id").alias("left_path"), F.col("right_id").alias("right_path"), "score")
    for side in ("left", "right"):
        pairs = pairs.join(files.select(F.col("path").alias(f"{side}_path"), F.col("version").alias(f"{side}_version")), f"{side}_path")
    return pairs


@dataclass(frozen=True)
class CorpusLog:
    """The log in a folder, for one threshold. One stream writes it; its checkpoint and the folder belong together."""

    spark: SparkSession
    folder: str
    threshold: float
    every: int = 16

    # --- files --------------------------------------------------------------------------------------------------------
    def _path(self, part: str, table: str = "") -> str:
        return f"{self.folder.rstrip('/')}/{part}/{table}".rstrip("/")

    def _write(self, df: DataFrame, part: str, table: str) -> None:
        df.select(*_names(table)).write.mode("overwrite").parquet(self._path(part, table))

    def _read(self, table: str, *parts: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*(self._path(p, table) for p in parts))

    def _file(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def built(self) -> bool:
        files, at = self._file(self._path("gen=-1", "findings/_SUCCESS"))
        return files.exists(at)

    def _remove(self, part: str) -> None:
        files, at = self._file(self._path(part))
        files.delete(at, True)

    # --- state --------------------------------------------------------------------------------------------------------
    def view(self, batch: int) -> View:
        """What ``batch`` sees: the last generation before it, and the deltas since."""
        n = max(batch, 0) // self.every * self.every - 1
        return View(self, n, range(n + 1, batch))

    def after(self, batch: int) -> View:
        """What there is after ``batch``, -1 being the start."""
        n = self.view(batch).generation
        return View(self, n, range(n + 1, batch + 1))

    def build(self, corpus: DataFrame) -> None:
        """Generation -1: a corpus (path, text, and version where it has one, else 0) and the findings among it."""
        if "version" not in corpus.columns:
            corpus = corpus.withColumn("version", F.lit(0).cast("long"))
        files = stored(newest(corpus), "corpus")
        self._write(files, "gen=-1", "heads")
        self._write(_bags(files), "gen=-1", "bags")
        self._index("gen=-1")
        self._write(_found(self._read("packed", "gen=-1"), None, self.threshold), "gen=-1", "findings")

    def _index(self, part: str) -> None:
        """Numbers the features of a generation's bags by rarity, over a range sort, and packs the bags anew."""
        bags = self._read("bags", part)
        rarity = bags.groupBy("feature").agg(F.count("*").alias("df")).repartitionByRange("df", "feature").sortWithinPartitions("df", "feature")
        rank = F.shiftleft(J.rarity_class(F.col("df")), J.HASH).bitwiseOR(F.monotonically_increasing_id())
        self._write(rarity.withColumn("rank", rank), part, "rarity")
        self._write(_packed(bags, self._read("rarity", part)), part, "packed")

    def current_heads(self, batch: int) -> DataFrame:
        """(path, version) of the files that there are after ``batch``."""
        return self.after(batch).heads().where("not deleted").select("path", "version")

    def current_findings(self, batch: int) -> DataFrame:
        """All pairs of newest versions that reach the threshold, after ``batch``."""
        return self.after(batch).findings()

    # --- changes ------------------------------------------------------------------------------------------------------
    def apply(self, changes: DataFrame, batch: int) -> None:
        """Logs a batch of changes (path, version, text, and deleted where there are deletions) and its findings."""
        if batch and batch % self.every == 0:
            self._merge(batch)
        part, view = f"delta={batch}", self.view(batch)
        rows = stored(newest(changes), "changes")
        seen = view.heads().select("path", F.col("version").alias("seen"))
        late = seen.join(rows.select("path", "version"), "path").where("seen >= version").select("path")
        rows = stored(rows.join(late, "path", "left_anti"), "changed")
        self._write(rows, part, "heads")
        self._write(_bags(rows), part, "bags")
        own, known = self._read("bags", part), view.ranks()
        fresh = own.select("feature").distinct().join(known, "feature", "left_anti")
        lowest = NEW * (batch - view.generation)
        self._write(fresh.withColumn("rank", F.monotonically_increasing_id() - F.lit(lowest)), part, "rarity")
        self._write(_packed(own, known.unionByName(self._read("rarity", part))), part, "packed")
        live = view.live("packed").join(rows.select("path"), "path", "left_anti").unionByName(self._read("packed", part))
        self._write(_found(live, rows.select("path"), self.threshold), part, "findings")

    def _merge(self, batch: int) -> None:
        """What ``batch`` would see, as a generation.

        The generation before it and its deltas stay, as a rerun of this batch reads them; older ones go.
        """
        n, part = batch - 1, f"gen={batch - 1}"
        view = View(self, n - self.every, range(n - self.every + 1, batch))
        self._write(view.heads(), part, "heads")
        self._write(view.live("bags"), part, "bags")
        self._write(view.findings(), part, "findings")
        self._index(part)
        if view.generation >= 0:
            self._remove(f"gen={view.generation - self.every}")
            for k in range(view.generation - self.every + 1, view.generation + 1):
                self._remove(f"delta={k}")


@dataclass(frozen=True)
class View:
    """A generation with deltas on top, merged as it is read."""

    log: CorpusLog
    generation: int
    deltas: range

    def _base(self, table: str) -> DataFrame:
        return self.log._read(table, f"gen={self.generation}")

    def _changes(self, table: str) -> DataFrame:
        return self.log._read(table, *(f"delta={k}" for k in self.deltas))

    def fresh(self) -> DataFrame:
        """The newest state of the paths that deltas changed; no more of them than rows of the deltas."""
        states = self._changes("heads").groupBy("path").agg(F.max(F.struct("version", "deleted")).alias("r"))
        return states.select("path", "r.*")

    def heads(self) -> DataFrame:
        """The newest state of every path, deletions included: late versions of a deleted path are told by it."""
        fresh = self.fresh()
        return self._base("heads").join(fresh, "path", "left_anti").unionByName(fresh)

    def ranks(self) -> DataFrame:
        """The numbers of all features known so far; those that came with deltas are the lower."""
        return self._base("rarity").unionByName(self._changes("rarity"))

    def live(self, table: str) -> DataFrame:
        """Rows of bags or packed bags of the newest versions."""
        fresh = self.fresh()
        new = self._changes(table).join(fresh.where("not deleted"), ["path", "version"], "left_semi")
        return self._base(table).join(fresh, "path", "left_anti").unionByName(new)

    def findings(self) -> DataFrame:
        """Found pairs whose sides are both the newest versions."""
        found, fresh = self._base("findings").unionByName(self._changes("findings")), self.fresh()
        for side in ("left", "right"):
            now = fresh.select(F.col("path").alias(f"{side}_path"), F.col("version").alias("v"), F.col("deleted").alias("d"))
            same = F.col("v").isNull() | ((F.col("v") == F.col(f"{side}_version")) & ~F.col("d"))
            found = found.join(now, f"{side}_path", "left").where(same).drop("v", "d")
        return found.select(*_names("findings"))


def incremental_scan(stream: DataFrame, corpus: DataFrame, threshold: float, folder: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Keeps a log in ``folder`` of a corpus and of the stream's changes, with the findings of each micro-batch.

    The corpus is logged when the stream first starts. ``CorpusLog(...).current_findings(k)`` gives the state after batch
    k, whichever batches ran twice.
    """
    log = CorpusLog(corpus.sparkSession, folder, threshold, every)
    if not log.built():
        log.build(corpus)
    return stream.writeStream.foreachBatch(log.apply).option("checkpointLocation", checkpoint).start()
