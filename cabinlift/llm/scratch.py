"""Tables of one run of an operator, written to the shared folder and emptied when nothing reads them any more."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabinlift.sources.shared import shared_folder

#: Rows of a few numbers up to which a side of a join is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if it has at most ``most`` of them."""
    return F.broadcast(df) if df.count() <= most else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where ``df`` has a column so called already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Written copies cut the lineage; ``free`` gives their space back, which long jobs need."""

    def __init__(self) -> None:
        self._open: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """A reader of a written copy of ``df``."""
        path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        copy = df.sparkSession.read.schema(df.schema).parquet(path)
        self._open[id(copy)] = (copy, path)
        return copy

    def free(self, *keep: DataFrame) -> None:
        """Empty all tables but those that a result still reads."""
        spared = {id(df) for df in keep}
        for key, (copy, path) in list(self._open.items()):
            if key not in spared:
                copy.sparkSession.createDataFrame([], copy.schema).coalesce(1).write.mode("overwrite").parquet(path)
                del self._open[key]
