"""Guards on seeds: counted by the pass that does the work, refused after it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Seeds kept for the final evaluation, the first and how many.
HELDOUT_START, HELDOUT_COUNT = 900_000, 1_000


class SeedGuard:
    """Watches a column of seeds while its rows are used for something else, so no second scan is needed.

    heldout False: seeds are for training, those kept for the evaluation are refused; True: only those are taken. A null seed is refused by both. Call check() after the action on
    what watch() gave; it waits for that action's first run.
    """

    def __init__(self, heldout: bool = False, start: int = HELDOUT_START, count: int = HELDOUT_COUNT):
        self.heldout, self.start, self.count, self.seen = heldout, start, count, Observation()

    def watch(self, df: DataFrame, seed: str = "seed") -> DataFrame:
        kept = F.coalesce(F.col(seed).between(self.start, self.start + self.count - 1), F.lit(not self.heldout))
        wrong = kept != F.lit(self.heldout)
        return df.observe(self.seen, F.count_if(wrong).alias("wrong"), F.min(F.when(wrong, F.col(seed))).alias("first"), F.count("*").alias("rows"))

    def check(self) -> int:
        """The number of rows seen; a ValueError if a seed among them was wrong."""
        got = self.seen.get
        if got["wrong"]:
            raise ValueError(f"{got['wrong']} of {got['rows']} seeds are {'not ' if self.heldout else ''}reserved for held-out evaluation, {got['first']} among them")
        return got["rows"]
