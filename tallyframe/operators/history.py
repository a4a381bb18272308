"""Decision histories kept in a folder (F14): events, the state that they have come to, and commits that writers agree on.

A commit is one small file, named by its number, that lists the folders with the events and facts of all commits so far.
A writer reads the last commit, walks its new events from the kept state, writes what they come to aside and then puts the
file of the next number, which succeeds for one writer only. The others read again, judge again and try again: who comes
second with a sequence number that is taken is refused, and no reader ever sees half a commit.

Facts are kept once for each transaction that they are about, in order of account and transaction, so a few new events
read a few pages of them, however long the histories are.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize, reading
from . import decisions

#: Up to so many (account, transaction) of new events are sent to the scan of the facts as a filter; more are joined.
NAMED = 500
#: So many folders of facts make the next commit merge them.
FOLDERS = 32


class Conflict(Exception):
    """Other writers were first each time."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file that nobody may have written before; False if somebody has. The file is whole or not there.

    The text is written aside; then a hard link (local folders) or a rename (HDFS and stores whose rename refuses an
    existing target) gives it its name, both of which are one step that only one caller can do.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() != "file":
            return bool(fs.rename(aside, target))
        place = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
        try:
            jvm.java.nio.file.Files.createLink(place(target), place(aside))
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
    finally:
        fs.delete(aside, False)


class History:
    """Histories of many accounts in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/commits"))

    def version(self) -> int:
        """The number of the last commit, 0 if there is none."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.folder}/commits"))]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json"))])

    def _commit(self, version: int) -> dict:
        if version == 0:
            return {"events": [], "facts": []}
        stream = self._fs.open(self._path(f"{self.folder}/commits/{version:020d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _read(self, kind: str, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/{kind}/{f}" for f in folders]) if folders else None

    def events(self, version: int | None = None) -> DataFrame | None:
        """All events as of a commit (the last by default), with outcome and reason_lapsed; None before the first."""
        return self._read("events", self._commit(self.version() if version is None else version)["events"])

    def state(self, version: int | None = None) -> DataFrame | None:
        """The facts as of a commit (see decisions.facts), without those that hold no more."""
        rows = self._read("facts", self._commit(self.version() if version is None else version)["facts"])
        return None if rows is None else decisions.latest(rows).filter("value IS NOT NULL")

    def _met(self, commit: dict, new: DataFrame) -> tuple[DataFrame | None, bool]:
        """(facts of the transactions and accounts that new events name, whether these are few)"""
        of_account = new.select("account", F.lit("").alias("member"))
        named = new.select("account", F.explode(F.concat(*decisions._members(new).values())).alias("member")).unionByName(of_account)
        begun = {tuple(r) for r in named.limit(20 * NAMED).collect()}
        named = named.distinct()
        few = len(begun) <= NAMED
        if few:  # told apart in full only if the first rows leave it open
            some = named.limit(NAMED + 1).collect()
            few = len(some) <= NAMED
        rows = self._read("facts", commit["facts"])
        if rows is None:
            return None, few
        if few:  # both columns reach the scan
            pairs = {(r[0], r[1]) for r in some}
            rows = rows.filter(F.col("account").isin([*{a for a, _ in pairs}]) & F.col("member").isin([*{m for _, m in pairs}]))
            named = self.spark.createDataFrame([*pairs], named.schema) if pairs else named
        met = decisions.latest(rows.join(F.broadcast(named) if few else named, ["account", "member"], "left_semi"))
        return (met if few else materialize(met, "met")), few

    def _write(self, kind: str, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/{kind}/{name}")
        return name

    def _facts(self, rows: DataFrame, few: bool = False) -> DataFrame:
        """Facts as they are kept: a row for each transaction, in order of account and transaction."""
        member = F.explode(F.when(F.size("members") > 0, F.col("members")).otherwise(F.array(F.lit(""))))
        parts, rows = int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows.withColumn("member", member)
        rows = rows.coalesce(1) if few else rows.repartitionByRange(parts, "account", "member")
        return rows.sortWithinPartitions("account", "member")

    def append(self, new: DataFrame, verdicts: DataFrame | None = None, lapsing: bool = False, tries: int = 10) -> tuple[DataFrame, DataFrame]:
        """(taken, refused): the events that are in the history now, with their outcomes, and the accounts of which none is.

        An account's new events are taken whole if they follow its last seq one by one and none would lapse; lapsing
        takes those that lapse too, as when a history is imported. Events come in one form, by record or by unit key, in
        a folder. Raises Conflict if other writers come first `tries` times. What new events come from is computed once.
        """
        new = materialize(new, "new-events")
        for _ in range(tries):
            version = self.version()
            commit = self._commit(version)
            met, few = self._met(commit, new)
            name = self._write("events", decisions.replay(new, verdicts, met, few))
            walked = self._read("events", [name])
            last = self._none("account string, last long") if met is None else met.filter("kind = 'account'").select("account", F.col("seq").alias("last"))
            lapse = F.lit(False) if lapsing else F.bool_or(F.col("outcome") != "applied")
            turns = materialize(decisions.turns(walked, last, lapse.alias("lapse")), "turns")
            bad = reading(turns.filter("out_of_turn OR lapse").select("account"), turns)
            some = turns.agg(F.count("*"), F.count_if(F.col("out_of_turn") | F.col("lapse"))).first()
            if some[0] == some[1]:
                self._forget({"events": [name], "facts": []}, {"events": [], "facts": []})
                discard(new, *([met] if met is not None else []))
                return self._none(walked.schema), bad
            if some[1]:  # written again without the accounts that are refused
                taken = self._write("events", walked.join(bad, "account", "left_anti"))
                self._forget({"events": [name], "facts": []}, {"events": [], "facts": []})
                name = taken
            kept = self._read("events", [name])
            more = {"events": [*commit["events"], name], "facts": [*commit["facts"], self._write("facts", self._facts(decisions.facts(kept, met), few))]}
            if len(more["facts"]) > FOLDERS:
                whole = decisions.latest(self._read("facts", more["facts"])).filter("value IS NOT NULL")
                more["facts"] = [self._write("facts", self._facts(whole))]
            if put_if_absent(self.spark, f"{self.folder}/commits/{version + 1:020d}.json", json.dumps(more)):
                discard(new, *([met] if met is not None else []))
                return kept, bad
            self._forget(more, commit)
            discard(turns, *([met] if met is not None else []))
        raise Conflict(f"{tries} times another writer was first")

    def _none(self, schema) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _forget(self, more: dict, commit: dict) -> None:
        """Deletes what a commit that failed has written."""
        for kind in ("events", "facts"):
            for name in set(more[kind]) - set(commit[kind]):
                self._fs.delete(self._path(f"{self.folder}/{kind}/{name}"), True)
