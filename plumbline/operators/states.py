"""Where states are kept between runs."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.base import Analyzer, State


class InMemoryStateProvider:
    """States by analyzer and frequency tables by keys and filter; analyzers are looked up by value.

    Tables stay cached in Spark until clear().
    """

    keeps_tables = True

    def __init__(self):
        self._states: dict[str, State] = {}
        self._tables: dict[tuple, DataFrame] = {}

    def load(self, analyzer: Analyzer) -> State | None:
        return self._states.get(str(analyzer))

    def persist(self, analyzer: Analyzer, state: State) -> None:
        self._states[str(analyzer)] = state

    def load_frequencies(self, key: tuple) -> DataFrame | None:
        return self._tables.get(key)

    def persist_frequencies(self, key: tuple, table: DataFrame) -> None:
        self._tables[key] = table

    def clear(self) -> None:
        for table in self._tables.values():
            table.unpersist()
        self._states, self._tables = {}, {}


class FileStateProvider:
    """The same in a folder of any file system that Spark reaches: JSON for states, Parquet for frequency tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, text: str) -> str:
        return f"{self.path}/{hashlib.sha256(text.encode()).hexdigest()[:32]}"

    def load(self, analyzer: Analyzer) -> State | None:
        from plumbline.sources.files import read_text

        text = read_text(self.spark, self._place(str(analyzer)) + ".json")
        if text is None:
            return None
        return State({k: base64.b64decode(v["b"]) if isinstance(v, dict) else v for k, v in json.loads(text)["values"].items()})

    def persist(self, analyzer: Analyzer, state: State) -> None:
        from plumbline.sources.files import write_text

        values = {k: {"b": base64.b64encode(v).decode()} if isinstance(v, bytes) else v for k, v in state.values.items()}
        write_text(self.spark, self._place(str(analyzer)) + ".json", json.dumps({"analyzer": str(analyzer), "values": values}), True)

    def load_frequencies(self, key: tuple) -> DataFrame | None:
        from plumbline.sources.files import exists

        place = self._place(repr(key)) + ".parquet"
        return self.spark.read.parquet(place) if exists(self.spark, place) else None

    def persist_frequencies(self, key: tuple, table: DataFrame) -> None:
        from plumbline.sources.files import move

        place = self._place(repr(key)) + ".parquet"
        table.write.mode("overwrite").parquet(place + ".new")  # a table may be read from the place it goes to
        move(self.spark, place + ".new", place)
