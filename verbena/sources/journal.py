"""Append-only search journals: one JSON entry per line."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from verbena.operators.trials import latest_trial_state

JOURNAL_SCHEMA = (
    "study string, seq long, trial long, step int, state string, value double, "
    "lr double, kl_weight double"
)


def read_journal(spark: SparkSession, path: str, schema: str = JOURNAL_SCHEMA) -> DataFrame:
    """All entries of the journal files at a path."""
    return spark.read.schema(schema).json(path)


def append_journal(entries: DataFrame, path: str) -> None:
    """Add entries to a journal folder; what is there stays."""
    entries.write.mode("append").json(path)


def journal_files(spark: SparkSession, path: str) -> list[str]:
    """The journal files of a folder, by Spark's own file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = [status.getPath() for status in system.listStatus(folder) if status.isFile()]
    return sorted(str(p) for p in found if not p.getName().startswith(("_", ".")))


class JournalSnapshot:
    """A folder that holds what a journal has come to, and which of its files that covers.

    A snapshot is a folder with the table ``states`` and the list ``files.txt``; it counts once the list is
    there, as that is put in place last. So a job that is lost half-way leaves the one before as it was,
    and resuming reads that and the files it does not cover. A file is written once and never
    appended to, as ``append_journal`` does it.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        by: list[str],
        seq: str,
        values: list[str],
        schema: str = JOURNAL_SCHEMA,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.by, self.seq, self.values = by, seq, values

    def _system(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Complete snapshots, oldest first."""
        folder, system = self._system()
        if not system.exists(folder):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [status.getPath().getName() for status in system.listStatus(folder)]
        done = [n for n in names if system.exists(hadoop(f"{self.path}/{n}/files.txt"))]
        return sorted(done, key=lambda n: (int(n.split("-")[0]), n))

    def covered(self) -> set[str]:
        """The journal files in the last snapshot: a name for each, not their entries."""
        last = self.versions()[-1:]
        if not last:
            return set()
        jvm = self.spark._jvm
        stream = self._system()[1].open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{last[0]}/files.txt"))
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return set(text.split("\n")) - {""}

    def newer(self, log: str) -> list[str]:
        """The journal files that the last snapshot does not cover."""
        known = self.covered()
        return [f for f in journal_files(self.spark, log) if f not in known]

    def replay(self, log: str) -> DataFrame:
        """The last entry of each trial, from the snapshot and the newer files alone."""
        return self._states(self.newer(log))

    def _states(self, files: list[str]) -> DataFrame:
        columns = [*self.by, self.seq, *self.values]
        empty = self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).json(files) if files else empty]
        last = self.versions()[-1:]
        if last:
            states = self.spark.read.schema(parts[0].select(*columns).schema)
            parts.append(states.parquet(f"{self.path}/{last[0]}/states"))
        rows = parts[0].select(*columns)
        for part in parts[1:]:
            rows = rows.unionByName(part.select(*columns))
        return latest_trial_state(rows, self.by, self.seq, self.values)

    def compact(self, log: str, keep: int = 2) -> None:
        """Write a snapshot of all files there are now and remove all but the last ``keep``.

        The files are listed once, so entries that are added meanwhile wait for the next snapshot.
        """
        before, files = self.versions(), self.newer(log)
        covered = sorted(self.covered() | set(files))
        number = int(before[-1].split("-")[0]) + 1 if before else 0
        path = f"{self.path}/{number}-{uuid.uuid4().hex}"
        self._states(files).write.parquet(f"{path}/states")
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        _, system = self._system()
        listed = system.create(hadoop(f"{path}/files.tmp"))
        listed.write(bytearray("\n".join(covered).encode()))
        listed.close()
        system.rename(hadoop(f"{path}/files.tmp"), hadoop(f"{path}/files.txt"))
        for old in self.versions()[:-keep]:
            system.delete(hadoop(f"{self.path}/{old}"), True)

    def clear(self, log: str) -> None:
        """Remove the journal files that the last snapshot covers: their entries are in it."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        _, system = self._system()
        for file in sorted(self.covered() & set(journal_files(self.spark, log))):
            system.delete(hadoop(file), False)
