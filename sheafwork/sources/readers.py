"""Readers behind protocols: recognition and vision models are outside this engine, their contracts and doubles inside."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Unavailable(RuntimeError):
    """A reader that cannot be used here."""


class Reader(Protocol):
    """Turns batches of cells (cell_id, text) into readings (cell_id, reading)."""

    def available(self) -> bool: ...

    def read(self, cells: pd.DataFrame) -> pd.DataFrame: ...


class Echo:
    """Double that reads what is there."""

    def available(self) -> bool:
        return True

    def read(self, cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell_id": cells["cell_id"], "reading": cells["text"]})


class Silent(Echo):
    """Double that abstains."""

    def read(self, cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell_id": cells["cell_id"], "reading": ""})


_KNOWN: dict[str, Callable[[], Reader]] = {"echo": Echo, "silent": Silent}


def get_reader(name: str) -> Reader:
    """The reader of a name; unknown or unusable ones raise Unavailable."""
    if name not in _KNOWN or not (reader := _KNOWN[name]()).available():
        raise Unavailable(name)
    return reader


def read_cells(cells: DataFrame, name: str) -> DataFrame:
    """Readings of all cells; the reader is made once per worker, and a batch it fails on gives empty readings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = get_reader(name)
        for batch in batches:
            try:
                yield reader.read(batch)
            except Exception:  # noqa: BLE001 - a failing reader abstains
                yield pd.DataFrame({"cell_id": batch["cell_id"], "reading": ""})

    return cells.select("cell_id", "text").mapInPandas(run, "cell_id bigint, reading string")
