"""Teacher or student from loudness alone: the path for sessions without speaker turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 40
#: A centre that moves less than this (absolute, and as a share of where it was) stays. Fixed values.
STILL = 1e-8, 1e-5


class Rounds:
    """The rounds of one session, while its loudness values stream past in the direction the border moves.

    The border between the clusters only moves one way, since both means move with it: so a round ends
    where the first value beyond the border comes, and the next one goes on from there. What has passed is
    known by its count and sum. Values are streamed both ways; the first round tells which way it was.
    """

    def __init__(self, up: bool, low: float, high: float, count: int, total: float):
        self.up, self.before, self.centres = up, (low, high), (low, high)
        self.count, self.total, self.passed, self.sum, self.round = count, total, 0, 0.0, 0
        self.right_way = True

    def _means(self) -> tuple[float | None, float | None]:
        rest = self.count - self.passed
        passed = self.sum / self.passed if self.passed else None
        left = (self.total - self.sum) / rest if rest else None
        return (passed, left) if self.up else (left, passed)

    def _step(self) -> bool:
        """One round with what has passed as its cluster; whether it moved a centre."""
        new = tuple(c if m is None or abs(m - c) <= STILL[0] + STILL[1] * abs(c) else m for m, c in zip(self._means(), self.centres))
        moved = new != self.centres
        if self.round == 0:
            # Both ways have to agree, whatever the rounding of their sums.
            self.right_way = (sum(new) >= sum(self.centres) - 1e-7) == self.up
        self.before, self.centres, self.round = self.centres, new, self.round + 1
        return moved

    def take(self, values: np.ndarray, counts: np.ndarray) -> None:
        """The next values, from the quietest up or from the loudest down."""
        sums, numbers = np.cumsum(values * counts), np.cumsum(counts)
        at, start_sum, start_passed = 0, self.sum, self.passed
        while self.round < ROUNDS and at < len(values):
            low, high = self.centres
            lower = np.abs(values[at:] - low) <= np.abs(values[at:] - high)
            beyond = np.flatnonzero(lower != self.up)
            at = at + int(beyond[0]) if len(beyond) else len(values)
            if at:
                self.sum, self.passed = start_sum + float(sums[at - 1]), start_passed + int(numbers[at - 1])
            if at < len(values) and not (self._step() and self.right_way):
                self.round = ROUNDS

    def end(self) -> tuple[float, float, float, float]:
        while self.round < ROUNDS and self._step() and self.right_way:
            pass
        return (*self.before, *self.centres)


def loudness_centres(timeline: DataFrame) -> DataFrame:
    """Two loudness centres per session, started from the quietest and the loudest speech.

    cut_low and cut_high are the centres the last round divided by, low and high what it gave. Equal values are counted first;
    sums are decimals, so their order does not matter.
    """
    loud = timeline.filter((F.col("kind") == "speech") & F.col("rms_db").isNotNull())
    values = loud.groupBy("session_id", F.col("rms_db").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    amount = F.col("x").cast("decimal(22,16)") * F.col("n").cast("decimal(14,0)")
    ends = values.groupBy("session_id").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("n").alias("count"), F.sum(amount).alias("total"))
    directions = F.explode(F.array(F.lit(True), F.lit(False)))
    rows = values.join(ends.withColumn("total", F.col("total").cast("double")), "session_id").withColumn("up", directions).withColumn(
        "_along", F.when(F.col("up"), F.col("x")).otherwise(-F.col("x")))
    kind = timeline.schema["session_id"].dataType.simpleString()
    names = ["session_id", "cut_low", "cut_high", "low", "high"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rounds, done = None, None, []

        def close() -> None:
            if rounds is not None:
                centres = rounds.end()
                if rounds.right_way:
                    done.append((key[0], *centres))

        for batch in batches:
            if batch.empty:
                continue
            ids, ways = batch["session_id"].to_numpy(), batch["up"].to_numpy()
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (ways[1:] != ways[:-1])) + 1).tolist(), len(ids)]
            x, n = batch["x"].to_numpy(), batch["n"].to_numpy()
            for a, b in zip(edges[:-1], edges[1:]):
                if rounds is None or (ids[a], ways[a]) != key:
                    close()
                    key = ids[a], ways[a]
                    rounds = Rounds(*(batch[c].iat[a] for c in ("up", "low", "high", "count", "total")))
                rounds.take(x[a:b], n[a:b])
            yield pd.DataFrame(done, columns=names)
            done = []
        close()
        yield pd.DataFrame(done, columns=names)

    return rows.repartition("session_id").sortWithinPartitions("session_id", "up", "_along").mapInPandas(
        run, f"session_id {kind}, cut_low double, cut_high double, low double, high double")


def roles_from_loudness(timeline: DataFrame) -> DataFrame:
    """Label speech rows by the nearer centre; the louder one is the teacher.

    A single speech row, or rows of one loudness, are the teacher with confidence 0. Else
    confidence is how far a row lies inside its cluster, scaled by how far the centres are
    apart (12 dB and more counts in full).
    """
    speech = timeline.filter(F.col("kind") == "speech")
    facts = speech.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), (F.max("rms_db") - F.min("rms_db")).alias("spread"))
    rows = timeline.join(facts, "session_id", "left").join(
        loudness_centres(timeline), "session_id", "left")
    x, low, high = F.col("rms_db"), F.col("low"), F.col("high")
    in_low = F.abs(x - F.col("cut_low")) <= F.abs(x - F.col("cut_high"))
    apart = F.abs(low - high)
    own, other = F.when(in_low, low).otherwise(high), F.when(in_low, high).otherwise(low)
    margin = (F.abs(x - other) - F.abs(x - own)) / F.greatest(apart, F.lit(1e-9))

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    flat = (F.col("n") == 1) | (F.col("spread") < 1e-6)
    teacher = in_low == (low > high)
    is_speech = F.col("kind") == "speech"
    role = F.when(is_speech, F.when(flat | teacher, "teacher").otherwise("student"))
    conf = F.when(is_speech, F.when(flat, 0.0).otherwise(unit(margin) * unit(apart / 12.0)))
    return rows.withColumn("role", role).withColumn("role_conf", conf).drop(
        "n", "spread", "low", "high", "cut_low", "cut_high")
