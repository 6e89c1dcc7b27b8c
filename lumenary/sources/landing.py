"""Landed payloads as a data source of Spark, for batches and for streams.

A landing step fetches payloads and writes each, with where it came from, to a file of its own whose
name holds the landing number and the source. ``spark.read.format("landed")`` makes a partition of
each payload, or of several by the option ``payloadsPerTask``; only names are listed by the driver.
``spark.readStream.format("landed")`` takes the landing number as its offset, so a restart goes on
behind the last payload that was committed. The option ``sources`` takes a comma-separated list of
sources; the others' files are not opened. Parsers turn the rows into postings:

    register(spark)
    parse(spark.read.format("landed").load(folder), "rss")
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "source_id string, url string, fetched_at timestamp_ntz, payload string, landed_no long"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")


def land(folder: str, number: int, source_id: str, url: str, fetched_at: datetime, payload: str) -> None:
    """Write a payload; it is seen as a whole or not at all. Numbers grow, and a source's id takes no path of its own."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    name = f"{number:020d}-{quote(source_id, safe='')}"
    with store.open_output_stream(f"{root}/.{name}.part") as out:
        out.write(json.dumps({"url": url, "fetched_at": fetched_at.isoformat(), "payload": payload}).encode())
    store.move(f"{root}/.{name}.part", f"{root}/{name}.json")


@dataclass
class Payloads(InputPartition):
    """Names of the files of a task."""

    names: tuple[str, ...]


class _Landing:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.per_task = options["path"], int(options.get("payloadsPerTask", "1"))
        self.sources = set(options["sources"].split(",")) if "sources" in options else None

    def names(self, after: int = 0, upto: int | None = None) -> list[str]:
        """Files with landing numbers above ``after``, up to ``upto``, in order; no folder is an empty one."""
        store, root = _store(self.folder)
        found = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.endswith(".json") and not i.base_name.startswith("."))
        wanted = [n for n in found if after < int(n[:20]) and (upto is None or int(n[:20]) <= upto)]
        return [n for n in wanted if self.sources is None or unquote(n[21:-5]) in self.sources]

    def dealt(self, names: list[str]) -> list[Payloads]:
        return [Payloads(tuple(names[i : i + self.per_task])) for i in range(0, len(names), self.per_task)]

    def rows(self, part: Payloads) -> Iterator[tuple]:
        store, root = _store(self.folder)
        for name in part.names:
            with store.open_input_stream(f"{root}/{name}") as f:
                said = json.loads(f.read())
            yield unquote(name[21:-5]), said["url"], datetime.fromisoformat(said["fetched_at"]), said["payload"], int(name[:20])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.landing = _Landing(options)

    def partitions(self) -> list[Payloads]:
        return self.landing.dealt(self.landing.names())

    def read(self, partition: Payloads) -> Iterator[tuple]:
        return self.landing.rows(partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.landing = _Landing(options)

    def initialOffset(self) -> dict:
        return {"landed": 0}

    def latestOffset(self) -> dict:
        names = self.landing.names()
        return {"landed": int(names[-1][:20]) if names else 0}

    def partitions(self, start: dict, end: dict) -> list[Payloads]:
        return self.landing.dealt(self.landing.names(start["landed"], end["landed"]))

    def read(self, partition: Payloads) -> Iterator[tuple]:
        return self.landing.rows(partition)


class Landed(DataSource):
    """The source by the name of ``landed``."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landed)
