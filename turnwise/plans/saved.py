"""State of a run, kept by turn, so that a run that was stopped goes on after its last full turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.durable import exists


class TurnStore:
    """Tables by run, turn and name below a folder that all nodes share. A turn counts once it is closed."""

    def __init__(self, spark: SparkSession, folder: str, run: str):
        self.spark, self.folder = spark, f"{folder}/run={run}"

    def _path(self, turn: int, name: str) -> str:
        return f"{self.folder}/turn={turn:04d}/{name}"

    def put(self, turn: int, name: str, table: DataFrame) -> DataFrame:
        """Write a table of a turn, in place of one that a stopped run has left there, and read it back."""
        table.write.mode("overwrite").parquet(self._path(turn, name))
        return self.spark.read.schema(table.schema).parquet(self._path(turn, name))

    def get(self, turn: int, name: str) -> DataFrame | None:
        path = self._path(turn, name)
        return self.spark.read.parquet(path) if exists(self.spark, path) else None

    def close(self, turn: int, ended: bool) -> None:
        """The turn is whole; with ``ended`` the run is, too."""
        self.spark.range(1).select(F.lit(ended).alias("ended")).coalesce(1).write.mode("overwrite").parquet(self._path(turn, "closed"))

    def last(self) -> tuple[int, bool] | None:
        """(last full turn, whether the run has ended)."""
        turn = -1
        while exists(self.spark, f"{self._path(turn + 1, 'closed')}/_SUCCESS"):
            turn += 1
        return (turn, bool(self.get(turn, "closed").first()["ended"])) if turn >= 0 else None

    def all(self, name: str, turns: int) -> DataFrame | None:
        """The union of a table over the first ``turns`` turns."""
        out = None
        for turn in range(turns):
            part = self.get(turn, name)
            if part is not None:
                out = part if out is None else out.unionByName(part)
        return out
