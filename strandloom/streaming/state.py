"""Frequencies of units over a stream, with state by unit that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandloom.functions import dna
from strandloom.operators.decompose import decompose
from strandloom.plans.options import Options

#: The state store that keeps state by key on disk.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Of each class of rotations the number of reads, and the spelling in the first read, by its number, that has it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "freq long, first_ord long, unit string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        freq, first = 0, None
        if self.held.exists():
            freq, *first = self.held.get()
        for part in rows:
            freq += len(part)
            own = min(zip(part["read_ord"].tolist(), part["unit"].tolist(), strict=True))
            first = list(own) if first is None else min(first, list(own))
        self.held.update((freq, *first))
        yield pd.DataFrame({"canon": [key[0]], "unit": [first[1]], "first_ord": [first[0]], "freq": [freq]})

    def close(self) -> None:
        pass


def stream_library(reads: DataFrame, opts: Options = Options()) -> DataFrame:  # noqa: B008
    """canon, unit, first_ord, freq of every class of units that a batch of a stream of reads (read_ord, seq) touches; for update output.

    The spelling is that of the read with the smallest read_ord so far, so it
    doesn't depend on how the stream is cut into batches. Queries need
    spark.sql.streaming.stateStore.providerClass set to ROCKS.
    """
    own = decompose(reads, opts, key="read_ord").select("read_ord", F.explode("units").alias("u")).select("read_ord", "u.unit")
    keyed = own.select("read_ord", "unit", dna.canon(F.col("unit")).alias("canon"))
    return keyed.groupBy("canon").transformWithStateInPandas(FirstSeen(), "canon string, unit string, first_ord long, freq long", "Update", "None")
