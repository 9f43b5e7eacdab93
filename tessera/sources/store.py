"""Versions of artefacts in a folder that may be in any store of Hadoop's.

A version is written under a temporary name and renamed once its manifest, the last file, is
there: readers see whole versions or none, and what a lost driver left half-written has no
manifest under a version's name, so it is ignored and later removed.  A manifest holds the
names of the tables, a fingerprint of inputs and switches, a score and whatever the caller adds.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    manifest: dict

    @property
    def score(self) -> float | None:
        return self.manifest.get("score")


class ChangedInput(ValueError):
    """What is on record was made from other inputs or switches."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Hadoop's file system, whatever the scheme of the path.

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def write_text(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, at = self._at(path)
        source = fs.open(at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    # Versions.

    def versions(self, name: str) -> list[Version]:
        """Whole versions, the oldest first."""
        out = []
        for x in self.names(f"{self.root}/{name}"):
            path = f"{self.root}/{name}/{x}"
            if (m := re.fullmatch(r"v(\d+)", x)) and self.exists(f"{path}/{MANIFEST}"):
                out.append(Version(int(m[1]), path, json.loads(self.read_text(f"{path}/{MANIFEST}"))))
        return out

    def last(self, name: str) -> Version | None:
        return max(self.versions(name), key=lambda v: v.number, default=None)

    def best(self, name: str) -> Version | None:
        """The first version of the highest score."""
        scored = [v for v in self.versions(name) if v.score is not None]
        return max(scored, key=lambda v: (v.score, -v.number), default=None)

    def commit(self, name: str, tables: dict[str, DataFrame], fingerprint: str = "", score: float | None = None, **more) -> Version:
        """Writes the tables as a new version.  Of two writers at once, each gets a number of its own."""
        folder, temporary = f"{self.root}/{name}", f"{self.root}/{name}/.writing-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{temporary}/{table}")
        manifest = {"tables": sorted(tables), "fingerprint": fingerprint, "score": score, **more}
        fs, at = self._at(temporary)
        fs.mkdirs(at)
        self.write_text(f"{temporary}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
        taken = [int(m[1]) for x in self.names(folder) if (m := re.fullmatch(r"v(\d+)", x))]
        number = max(taken, default=0) + 1
        while True:
            to = f"{folder}/v{number:06d}"
            # a rename onto a folder would move into it, so that a number is only tried while it is free
            if not self.exists(to) and fs.rename(at, self._at(to)[1]) and not self.exists(f"{to}/{temporary.rpartition('/')[2]}"):
                return Version(number, to, manifest)
            stray = f"{to}/{temporary.rpartition('/')[2]}"
            if self.exists(stray):
                fs.rename(self._at(stray)[1], at)
            number += 1

    def table(self, version: Version, name: str) -> DataFrame:
        if name not in version.manifest["tables"]:
            raise ValueError(f"{version.path} has no table {name!r}")
        return self.spark.read.parquet(f"{version.path}/{name}")

    def resume(self, name: str, fingerprint: str) -> Version | None:
        """The last version, None if there is none; ``ChangedInput`` if it is of other inputs."""
        found = self.last(name)
        if found and found.manifest["fingerprint"] != fingerprint:
            raise ChangedInput(f"{found.path} was made from other inputs or switches")
        return found

    def prune(self, name: str) -> None:
        """Removes all but the last and the best version, and what was never finished."""
        kept = {v.number for v in (self.last(name), self.best(name)) if v}
        for x in self.names(f"{self.root}/{name}"):
            m = re.fullmatch(r"v(\d+)", x)
            if x.startswith(".writing-") or m and int(m[1]) not in kept:
                self.delete(f"{self.root}/{name}/{x}")


def content(df: DataFrame) -> str:
    """A fingerprint of a table's rows, in whatever order and partitions."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    got = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), got["n"], str(got["s"]), got["x"]]).encode()).hexdigest()


def fingerprint(tables: Iterable[DataFrame], **switches) -> str:
    """Of inputs (one pass over each) and of the switches that what is made depends on."""
    parts = [content(t) for t in tables]
    return hashlib.sha256(json.dumps([parts, switches], sort_keys=True, default=str).encode()).hexdigest()
