"""Numbered commits below a folder, each made by one writer or not at all.

A commit is a folder named by its number that holds one empty file, whose name
says what was committed.  A writer prepares the folder aside and renames it to
the next number: a rename is atomic and the folder is not empty, so of several
writers one gets the number, and a reader never sees half a commit.  The others
find another name there (their folder lands inside the winner's, where nothing
looks, or stays aside), and take it that their number is gone.  This needs a
file system with an atomic rename of folders, as HDFS and local disks have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has taken the number."""


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, number: int) -> str | None:
        at = self._path(f"{self.folder}/{number:0{DIGITS}d}")
        files = [s.getPath().getName() for s in self._fs.listStatus(at) if s.isFile()]
        return next((f for f in files if not f.startswith(".")), None)

    def _numbers(self) -> list[int]:
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if len(n) == DIGITS and n.isdigit())

    def entries(self) -> list[str]:
        """What was committed, in order of the numbers, which start at 1 and have no gap."""
        return [self._name(n) for n in self._numbers()]

    def last(self) -> tuple[int, str | None]:
        """The last number, 0 if there is none, and what it committed."""
        numbers = self._numbers()
        return (numbers[-1], self._name(numbers[-1])) if numbers else (0, None)

    def claim(self, number: int, name: str) -> bool:
        """Commit ``name`` as ``number``; False if another writer was first."""
        target = self._path(f"{self.folder}/{number:0{DIGITS}d}")
        if self._fs.exists(target):
            return False
        aside = f"{self.folder}/.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(aside))
        self._fs.create(self._path(f"{aside}/{name}"), False).close()
        self._fs.rename(self._path(aside), target)
        return self._name(number) == name
