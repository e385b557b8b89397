"""Guard rails of loops, and how many cores a job may take."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Valve:
    """Ends a loop that goes on too long: by its steps in all, or by steps in a row that leave its state as it was."""

    def __init__(self, steps: int = 1000, unchanged: int = 10):
        self.steps, self.unchanged = steps, unchanged
        self.taken, self.same, self.state = 0, 0, None

    def step(self, message: str = "") -> int:
        """Counts a step; more than allowed are an error.  How many there were."""
        self.taken += 1
        if self.taken > self.steps:
            raise RuntimeError(f"more than {self.steps} steps. {message}".rstrip())
        return self.taken

    def seen(self, state: object, message: str = "") -> None:
        """Compares the state with the one before; the same one too often in a row is an error."""
        self.same = self.same + 1 if self.taken and state == self.state else 0
        self.state, self.taken = state, max(1, self.taken)
        if self.same >= self.unchanged:
            raise RuntimeError(f"{self.unchanged} steps without a change. {message}".rstrip())


def usable_cores(spark: SparkSession) -> int:
    """The session's cores less those left to others: three of more than seven, two of more than three, one of more than one."""
    cores = spark.sparkContext.defaultParallelism
    # fixed values: from how many cores on how many are left
    for above, left in ((7, 3), (3, 2), (1, 1)):
        if cores > above:
            return cores - left
    return 1
