"""Version history: append-only segments of changes, one commit file a generation, and reads as of any of them.

A publication is written in three steps. The next state and its segment, the
rows that the generation changed, go to folders of their own, which nobody
reads yet. Their counts are checked against the run's. Then the commit file of
the next number is made to appear, whole, and only if there is none: of two
writers on one base one gets it, the other learns of the conflict. Versions and
presence at any generation follow from the segments up to it; each is as large
as what changed, and none is ever rewritten.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.operators import snapshots
from reviewlake.operators.ranges import parts

#: Changes that open a version, those that close the one before, and those of a presence.
OPENS = ("inserted", "updated", "reactivated_updated")
CLOSES = ("updated", "reactivated_updated")
STILL = ("unchanged", "kept")


class Refused(RuntimeError):
    """A publication that must not happen; ``code`` says why."""

    def __init__(self, code: str, said: str) -> None:
        super().__init__(f"{code}: {said}")
        self.code = code


@dataclass(frozen=True)
class Commit:
    """What a commit file says. The counts follow the run: a reactivated review counts as updated or unchanged too."""

    generation: int
    run_id: int
    base_run: int | None
    complete: bool
    state: str
    segment: str
    inserted: int
    updated: int
    unchanged: int
    reactivated: int
    suspect_missing: int
    tombstoned: int
    present: int


class Files:
    """The few file operations that Spark has no reader or writer for, on whatever file system holds the folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def appear(self, path: str, text: str) -> bool:
        """Makes a file with this text, whole from its first moment; False if there is one already.

        It is written under another name and then renamed, which on a shared
        file system fails where the name is taken. A local file system would
        rename over it, so there the file is linked.
        """
        made, target = self._path(f"{path}.{uuid.uuid4().hex}"), self._path(path)
        stream = self._fs.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() != "file":
                return self._fs.rename(made, target)
            paths = self._jvm.java.nio.file.Paths
            self._jvm.java.nio.file.Files.createLink(paths.get(self._fs.makeQualified(target).toUri()), paths.get(self._fs.makeQualified(made).toUri()))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(made, False)


class History:
    """Published generations under one folder; ``content`` names the columns that a version carries beside its hash."""

    def __init__(self, spark: SparkSession, root: str, content: tuple[str, ...] = ("tenths",)) -> None:
        self.spark, self.root, self.content = spark, root.rstrip("/"), content
        self._files = Files(spark, self.root)

    def _named(self, generation: int) -> str:
        return f"{self.root}/commits/{generation:012d}.json"

    def commits(self, until: int | None = None) -> list[Commit]:
        """All commits in order, or those up to a generation: one small file each."""
        numbers = [int(n[:12]) for n in self._files.names(f"{self.root}/commits") if n[12:] == ".json"]
        return [Commit(**json.loads(self._files.read(self._named(n)))) for n in numbers if until is None or n <= until]

    def head(self) -> Commit | None:
        found = [n for n in self._files.names(f"{self.root}/commits") if n[12:] == ".json"]
        return Commit(**json.loads(self._files.read(f"{self.root}/commits/{found[-1]}"))) if found else None

    def publish(self, staged: DataFrame, run_id: int, base_run: int | None, final_count: int, complete: bool = True) -> tuple[Commit, bool]:
        """The commit of a run, and whether it was there before.

        ``base_run`` is the run that was published when this one began,
        ``final_count`` what the source said at its end. Refused: a run that
        was published earlier than the last one (RUN_NOT_READY), another base
        than the last (STALE_BASE_PUBLICATION), an identity staged twice or
        missing (RECONCILIATION_MISMATCH), a complete run with another number
        of reviews (the same), a number of present reviews that is not the
        source's (PROMOTION_COUNT_MISMATCH). What is refused leaves nothing.
        """
        head = self.head()
        if head and head.run_id == run_id:
            return head, True
        if any(c.run_id == run_id for c in self.commits()):
            raise Refused("RUN_NOT_READY", f"run {run_id} was published before {head.run_id}")
        if (head.run_id if head else None) != base_run:
            raise Refused("STALE_BASE_PUBLICATION", f"expected {base_run}, found {head.run_id if head else None}")
        generation, attempt = (head.generation if head else 0) + 1, uuid.uuid4().hex
        state, segment = f"{self.root}/states/{attempt}", f"{self.root}/segments/{attempt}"
        try:
            before = self.spark.read.parquet(head.state) if head else None
            tasks = parts(self.spark, final_count + (before.count() if head else 0))
            snapshots.promote(before, staged, run_id, complete, self.content, tasks).write.parquet(state)
            rows = self.spark.read.parquet(state)
            counts = self._checked(rows, final_count, complete)
            rows.drop("staged").filter(~F.col("change").isin(*STILL)).withColumn("generation", F.lit(generation)).write.parquet(segment)
            commit = Commit(generation, run_id, base_run, complete, state, segment, **counts)
            if not self._files.appear(self._named(generation), json.dumps(asdict(commit))):
                raise Refused("STALE_BASE_PUBLICATION", f"another run became generation {generation}")
        except BaseException:
            self._files.remove(state)
            self._files.remove(segment)
            raise
        return commit, False

    def _checked(self, rows: DataFrame, final_count: int, complete: bool) -> dict[str, int]:
        nameless = F.coalesce(*[F.when(F.col(k).isNull(), True) for k in snapshots.KEYS], F.lit(False))
        change, n = F.col("change"), lambda *kinds: F.count_if(F.col("change").isin(*kinds))
        figures = {
            "inserted": n("inserted"), "updated": n(*CLOSES), "unchanged": n("unchanged", "reactivated"), "reactivated": n("reactivated", "reactivated_updated"),
            "suspect_missing": n("suspect_missing"), "tombstoned": n("tombstoned"), "present": F.count_if((F.col("presence") == "present") & change.isNotNull()),
        }
        # A name that is there twice counts once, as does one that is missing.
        figures |= {"reviews": F.count_if(F.col("staged") == 1), "bad": F.count_if(F.col("staged") == F.when(nameless, 1).otherwise(2))}
        counts = rows.agg(*[c.alias(k) for k, c in figures.items()]).first().asDict()
        bad, reviews = counts.pop("bad"), counts.pop("reviews")
        if bad or complete and reviews != final_count:
            raise Refused("RECONCILIATION_MISMATCH", f"{reviews} identities of {final_count}, {bad} of them staged twice or without a name")
        if counts["present"] != final_count:
            raise Refused("PROMOTION_COUNT_MISMATCH", f"{counts['present']} reviews are present, the source has {final_count}")
        return counts

    def current(self) -> DataFrame:
        """The state of the last generation, a row for each identity."""
        head = self.head()
        if head is None:
            raise LookupError("nothing is published yet")
        return self.spark.read.parquet(head.state).drop("staged")

    def _segments(self, until: int | None, since: int = 0) -> DataFrame:
        found = [c.segment for c in self.commits(until) if c.generation > since]
        if not found:
            raise LookupError("no generation lies there")
        return self.spark.read.parquet(*found)

    def versions(self, until: int | None = None) -> DataFrame:
        """Every version up to a generation: its content, the generation that opened it, the one that closed it (null: none yet), is_current."""
        log = self._segments(until)
        record = F.struct("record_hash", *self.content)
        opened = log.filter(F.col("change").isin(*OPENS)).select(*snapshots.KEYS, "version", F.col("generation").alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), record.alias("record"))
        closed = log.filter(F.col("change").isin(*CLOSES)).select(*snapshots.KEYS, (F.col("version") - 1).alias("version"), F.lit(None).cast("int").alias("valid_from"), F.col("generation").alias("valid_to"), F.lit(None).cast(opened.schema["record"].dataType).alias("record"))
        found = opened.unionByName(closed).groupBy(*snapshots.KEYS, "version").agg(F.max("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to"), F.max("record").alias("record"))
        return found.select(*snapshots.KEYS, "version", "record.*", "valid_from", "valid_to", F.col("valid_to").isNull().alias("is_current"))

    def as_of(self, generation: int) -> DataFrame:
        """Each identity as that generation had it: its version, content and presence. Reads the segments up to it, in one aggregation."""
        log = self._segments(generation)
        opened = F.col("change").isin(*OPENS)
        last = F.max_by(F.struct("version", "record_hash", *self.content), F.when(opened, F.col("generation")))
        found = log.groupBy(*snapshots.KEYS).agg(last.alias("last"), F.max_by("presence", "generation").alias("presence"))
        return found.select(*snapshots.KEYS, "last.*", "presence")

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """The rows that generations after ``since`` changed, as those generations left them."""
        return self._segments(until, since)

    def delta(self, since: int, until: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(removed, added): the present reviews that generations after ``since`` took away, as they stood before, and those that they brought.

        An updated review is in both. Over several generations a review may be
        removed and added again and again; the differences of any sums are right.
        """
        log = self.changes(since, until)
        names = ("record_hash", *self.content)
        removed = log.filter("was.presence = 'present'").select(*snapshots.KEYS, *[F.col(f"was.{c}").alias(c) for c in names])
        return removed, log.filter("presence = 'present'").select(*snapshots.KEYS, *names)

    def present(self) -> DataFrame:
        """The reviews that the last generation has."""
        return self.current().filter("presence = 'present'").select(*snapshots.KEYS, "record_hash", *self.content)

    def table(self) -> DataFrame:
        """The commits as rows."""
        rows = [(c.generation, c.run_id, c.base_run, c.complete, c.inserted, c.updated, c.unchanged, c.reactivated, c.suspect_missing, c.tombstoned, c.present) for c in self.commits()]
        counts = "inserted long, updated long, unchanged long, reactivated long, suspect_missing long, tombstoned long, present long"
        return self.spark.createDataFrame(rows, f"generation int, run_id int, base_run int, complete boolean, {counts}")

    def forget_states(self) -> int:
        """Removes the states of all generations but the last; versions() and as_of() don't need them. Returns how many there were."""
        held = {c.state.rsplit("/", 1)[1] for c in self.commits()[:-1]} & set(self._files.names(f"{self.root}/states"))
        for name in held:
            self._files.remove(f"{self.root}/states/{name}")
        return len(held)
