"""Peer sources: a registry of DataFrame sources, and one over a landing folder as a Python data source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class PeerSource:
    """Where peers come from; ``load`` gives code, name, market, currency and figures."""

    name: str
    market: str
    currency: str
    has_prices: bool
    load: Callable[[SparkSession], DataFrame]


_SOURCES: dict[str, PeerSource] = {}


def register(source: PeerSource, replace: bool = False) -> None:
    """Adds a source; a name that is taken needs ``replace`` (U4)."""
    if source.name in _SOURCES and not replace:
        raise ValueError(f"peer source {source.name!r} is registered already")
    _SOURCES[source.name] = source


def get(name: str) -> PeerSource:
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


class PeerJson(DataSource):
    """spark.read.format("peer_json").option("rows", json): a list of peer objects, for small hand-made lists."""

    @classmethod
    def name(cls) -> str:
        return "peer_json"

    def schema(self) -> str:
        return "code string, name string, market string, currency string, metric string, value double"

    def reader(self, schema) -> DataSourceReader:
        return _PeerReader(self.options.get("rows", "[]"))


class _PeerReader(DataSourceReader):
    def __init__(self, rows: str):
        self.rows = rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in json.loads(self.rows):
            for metric, value in (r.get("metrics") or {}).items():
                yield r.get("code"), r.get("name"), r.get("market"), r.get("currency"), metric, None if value is None else float(value)
