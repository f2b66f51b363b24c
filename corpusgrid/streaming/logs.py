"""Structured Streaming over append-only metric logs (R1-R4), each with its batch twin."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LOG = "event string, run long, seq long, score double, loss double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parsed(lines: DataFrame) -> DataFrame:
    """The columns of LOG, value and bad for lines (value) of a log, one JSON object each; blank lines go.

    A line that does not parse, or that names no event, is bad: its columns are null and the line stays in value. Fields
    that are missing or of another type are null. For batches and streams.
    """
    x = lines.where(F.trim("value") != "").withColumn("_r", F.from_json("value", f"{LOG}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r._corrupt").isNotNull() | F.col("_r.event").isNull()
    fields = [F.when(~bad, F.col(f"_r.{c.split()[0]}")).alias(c.split()[0]) for c in LOG.split(", ")]
    return x.select(*fields, "value", F.coalesce(bad, F.lit(True)).alias("bad"))


def tail_lines(lines: DataFrame) -> DataFrame:
    """tail() of a log's lines, and bad: how many lines could not be read, all of them in the row without a run."""
    x = parsed(lines)
    return _tail(x, F.count_if("bad").alias("bad"))


def route_lines(lines: DataFrame, out: str, checkpoint: str):
    """A stream of lines into the tables {out}/events and {out}/dead (value); a batch that was cut off is written again
    as a whole. Returns the finished query; available files are read, then it ends."""

    def write(df: DataFrame, number: int) -> None:
        x = parsed(df).persist()
        x.where("not bad").drop("value", "bad").write.mode("overwrite").parquet(f"{out}/events/micro={number}")
        x.where("bad").select("value").write.mode("overwrite").parquet(f"{out}/dead/micro={number}")
        x.unpersist()

    q = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def tail(events: DataFrame) -> DataFrame:
    """Per run: last event, last finished epoch, warnings. Works on batches and, in complete mode, on streams."""
    return _tail(events)


def _tail(events: DataFrame, *more) -> DataFrame:
    epoch = F.col("event") == "epoch"
    return events.groupBy("run").agg(F.max_by("event", "seq").alias("last_event"), F.max(F.when(epoch, F.col("seq"))).alias("last_epoch"), F.count_if(F.col("event") == "warning").alias("warnings"), F.count("event").alias("events"), *more)


def _advance(state: tuple, score: float, loss: float, gain: float, drop: float, least: int, patience: int) -> tuple[tuple, bool]:
    """(best score, lowest loss, stale, epochs) after one epoch, and whether to stop."""
    best, low, stale, n = state
    better = best is None or score >= best + gain or loss <= low - drop
    state = (max(best, score) if best is not None else score, min(low, loss) if low is not None else loss, 0 if better else stale + 1, n + 1)
    return state, state[3] >= least and state[2] >= patience


def plateau(events: DataFrame, gain: float = 0.005, drop: float = 0.02, least: int = 8, patience: int = 3) -> DataFrame:
    """R2, batch: per run the first epoch at which neither score nor loss has improved for `patience` epochs; null if none.

    Epochs are folded in order inside the run's array.
    """
    runs = events.where("event = 'epoch'").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "score", "loss"))).alias("es"))
    none = F.lit(None)
    start = F.struct(none.cast("double").alias("best"), none.cast("double").alias("low"), F.lit(0).alias("stale"), F.lit(0).alias("n"), none.cast("long").alias("stop"))

    def step(acc, e):
        better = acc["best"].isNull() | (e["score"] >= acc["best"] + gain) | (e["loss"] <= acc["low"] - drop)
        stale, n = F.when(better, 0).otherwise(acc["stale"] + 1), acc["n"] + 1
        stop = F.coalesce(acc["stop"], F.when((n >= least) & (stale >= patience), e["seq"]))
        return F.struct(F.greatest(acc["best"], e["score"]).alias("best"), F.least(acc["low"], e["loss"]).alias("low"), stale.alias("stale"), n.alias("n"), stop.alias("stop"))

    return runs.select("run", F.aggregate("es", start, step, lambda a: a["stop"]).alias("stop_epoch"))


def plateau_stream(events: DataFrame, gain: float = 0.005, drop: float = 0.02, least: int = 8, patience: int = 3) -> DataFrame:
    """R2, stream: the same with state per run; emits a row when a run should stop, once. Files must arrive in order of seq."""

    def one(key, frames, state):
        held = state.get if state.exists else (None, None, 0, 0, None)
        held, stop = tuple(None if x is None or x != x else x for x in held[:4]), held[4]
        stop = None if stop is None or stop != stop else int(stop)
        found = None
        # what one trigger brings of a run is ordered here; triggers themselves must come in order
        for seq, score, loss in pd.concat(frames).sort_values("seq")[["seq", "score", "loss"]].itertuples(index=False):
            held, now = _advance((held[0], held[1], int(held[2]), int(held[3])), score, loss, gain, drop, least, patience)
            if now and stop is None:
                found = stop = int(seq)
        if found is not None:
            yield pd.DataFrame({"run": [key[0]], "stop_epoch": [found]})
        state.update((held[0], held[1], int(held[2]), int(held[3]), stop))

    return events.where("event = 'epoch'").groupBy("run").applyInPandasWithState(
        one, "run long, stop_epoch long", "best double, low double, stale int, n int, stop long", "append", "NoTimeout"
    )


#: Early epochs of a run that share an entry of its buffer: those of equal seq // CHUNK.
CHUNK = 256


class PlateauProcessor(StatefulProcessor):
    """R2 for one run: epochs that came too early wait in a buffer until those before them are there, or until a timer says
    that these are lost. State is read and written by chunks of epochs, each once for the rows that arrive together."""

    def __init__(self, wait_ms: int | None, **rule):
        self.wait_ms, self.rule = wait_ms, rule

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "next long, best double, low double, stale int, n int, stop long")
        self.early = handle.getMapState("early", "chunk long", "seqs array<long>, scores array<double>, losses array<double>")

    def _held(self) -> list:
        found = self.progress.get() or [1, None, None, 0, 0, None]
        return [None if x is None or x != x else x for x in found]

    def _take(self, held: list, arrived: dict) -> int | None:
        """Adds the epochs that arrived (seq: score and loss) and folds those that follow on the last one; the epoch at which
        the run should stop, once."""
        chunks: dict[int, dict] = {}

        def chunk(seq: int) -> dict:
            c = seq // CHUNK
            if c not in chunks:
                kept = self.early.getValue((c,)) if self.early.containsKey((c,)) else None
                chunks[c] = dict(zip(kept[0], zip(kept[1], kept[2]))) if kept else {}
                before[c] = len(chunks[c])
            return chunks[c]

        before: dict[int, int] = {}
        touched = {seq // CHUNK for seq in arrived}
        for seq, values in arrived.items():
            chunk(seq)[seq] = values
        found, (nxt, *state, stop) = None, held
        while (now := chunk(nxt)).get(nxt) is not None:
            score, loss = now.pop(nxt)
            touched.add(nxt // CHUNK)
            state, over = _advance((state[0], state[1], int(state[2]), int(state[3])), score, loss, **self.rule)
            if over and stop is None:
                found = stop = nxt
            nxt += 1
        for c in touched:
            if chunks[c]:
                self.early.updateValue((c,), (list(chunks[c]), [x for x, _ in chunks[c].values()], [x for _, x in chunks[c].values()]))
            elif before[c]:
                self.early.removeKey((c,))
        held[:] = [nxt, *state, stop]
        return found

    def handleInputRows(self, key, rows, timerValues):
        held = self._held()
        for frame in rows:
            came = zip(*(frame[c].tolist() for c in ("seq", "score", "loss")))
            # what was folded before is a repeat
            found = self._take(held, {int(seq): (float(score), float(loss)) for seq, score, loss in came if seq >= held[0]})
            if found is not None:
                yield pd.DataFrame({"run": [key[0]], "stop_epoch": [found]})
        self.progress.update(tuple(held))
        if self.wait_ms is not None and self.early.exists() and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        waiting = [k[0] for k in self.early.keys()]
        if waiting:
            held = self._held()
            held[0] = min(self.early.getValue((min(waiting),))[0])
            found = self._take(held, {})
            self.progress.update(tuple(held))
            if found is not None:
                yield pd.DataFrame({"run": [key[0]], "stop_epoch": [found]})
            if self.early.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def close(self) -> None:
        pass


def plateau_any_order(events: DataFrame, wait_ms: int | None = None, gain: float = 0.005, drop: float = 0.02, least: int = 8, patience: int = 3) -> DataFrame:
    """R2, stream: a row when a run should stop, once, for epochs (seq 1, 2, ...) that arrive in any order and more than once.

    An epoch that is missing holds its run up; with wait_ms, for that much processing time at most, then it counts as lost.
    Spark keeps a query with such timers running, so wait_ms is for queries that never end, not for available-now ones.
    Needs the RocksDB state store when the query starts: see rocks().
    """
    processor = PlateauProcessor(wait_ms, gain=gain, drop=drop, least=least, patience=patience)
    return events.where("event = 'epoch'").groupBy("run").transformWithStateInPandas(processor, "run long, stop_epoch long", "Append", "None" if wait_ms is None else "ProcessingTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def worsening(events: DataFrame, by: float = 0.025, times: int = 2) -> DataFrame:
    """Epochs at which the loss has risen by more than `by` for the times-th time in a row."""
    w = Window.partitionBy("run").orderBy("seq")
    x = events.where("event = 'epoch'").withColumn("up", F.coalesce(F.col("loss") > F.lag("loss").over(w) + by, F.lit(False)))
    x = x.withColumn("island", F.sum((~F.col("up")).cast("int")).over(w))
    x = x.withColumn("streak", F.sum(F.col("up").cast("int")).over(Window.partitionBy("run", "island").orderBy("seq")))
    return x.where(F.col("up") & (F.col("streak") == times)).select("run", "seq")


def audit_batches(stream: DataFrame, out: str, checkpoint: str, audit, key: str = "batch_id"):
    """Rows of the stream audited and appended; a replay of the same rows adds nothing.

    Each micro-batch writes the folder of its own number, in overwrite mode: a batch that was cut off is written again as a
    whole. A batch id may arrive in several micro-batches; each part is audited and kept, with its rows in the column
    part_rows and a digest of them in part. A part whose digest is there already, as in a replay under another checkpoint, is
    left out. Returns the finished query; available files are read, then it ends.
    """

    def write(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
        parts = df.groupBy(key).agg(F.count(F.lit(1)).alias("part_rows"), F.sha2(F.concat_ws(":", F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)), 256).alias("part"))
        own = f"run={hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}/micro={number}"
        try:
            done = spark.read.parquet(out).where((F.col("run") != own.split("/")[0][4:]) | (F.col("micro") != number)).select(key, "part")
            parts = parts.join(done, [key, "part"], "left_anti")
        except Exception as missing:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
        audit(df.join(parts.select(key), key, "left_semi")).join(parts, key).write.mode("overwrite").parquet(f"{out}/{own}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
