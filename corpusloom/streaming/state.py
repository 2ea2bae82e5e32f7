"""Keyed state over Structured Streaming: chunks in order and once, and the last few rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.streaming.chunks import DONE, ERROR
from corpusloom.tables import shared_dir

#: States that keys are dealt to by hash, and new rows that a ring's state takes in at once.
STATES, CUT_ROWS = 256, 100_000


def _load(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(packed).read_all().to_pandas()


def _pack(frame: pd.DataFrame) -> bytes:
    table, out = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _share(key: Column, states: int) -> Column:
    """The state that holds a key, by its hash; keys that are null have one of their own."""
    return F.when(key.isNotNull(), F.pmod(F.hash(key), F.lit(states)))


def _plain(value: object) -> object:
    """value so that it can be hashed."""
    if isinstance(value, dict):
        return tuple((k, _plain(x)) for k, x in value.items())
    return tuple(map(_plain, value)) if isinstance(value, list | tuple | np.ndarray) else value


def _numbers(known: pd.Series | None, new: pd.Series, null: bool) -> tuple[np.ndarray, pd.Series]:
    """The place of each of `new` among the keys, and all keys: `known` in its order, then others."""
    if null:
        return np.zeros(len(new), "int64"), pd.Series([None], dtype=object)
    every = new if known is None else pd.concat([known, new])
    nested = isinstance(every.iloc[0], dict | list | tuple | np.ndarray)
    codes = pd.factorize(every.map(_plain) if nested else every, use_na_sentinel=False)[0]
    first = np.unique(codes, return_index=True)[1]
    return codes[0 if known is None else len(known) :], every.take(first).reset_index(drop=True)


def _grown(values: np.ndarray | pd.Series | None, n: int, kind: str) -> np.ndarray:
    """values, and zeros behind them up to n."""
    out = np.zeros(n, kind)
    if values is not None:
        out[: len(values)] = values
    return out


def in_order(chunks: DataFrame, stream: str, seq: str, chunk: str, idle_ms: int | None = None, states: int = STATES) -> DataFrame:
    """(stream, seq, chunk, closed): each chunk once and in order, from chunks that come late,
    out of order or again after a restart.

    chunks: a stream id, the chunk's number from 0 (a long) and its text. A chunk goes out as
    soon as all before it have; those that come early wait in the state, those that went out
    are dropped. A chunk that begins with `[DONE]` or `[ERROR]` closes its stream: it goes out
    as a row without text and `closed` set, and all that follow are dropped. With `idle_ms`,
    state goes that long after a stream's last chunk, by the cluster's clock; if it wasn't
    closed by then, what waits goes out with its numbers, behind the gap, and then a closing
    row without a number. Such a timer never lets a run over what is there now come to its end,
    so it is for streams that go on. Without, a stream's next number stays for good. Chunks
    without a stream, a number or a text are left out.

    Streams are dealt to `states` states by the hash of their ids (not maps), since a
    call of Python costs some milliseconds; `states` must stay what it was while a checkpoint is used.
    """
    kind = chunks.schema[stream].dataType.simpleString()
    out = ["stream", "seq", "chunk", "closed"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # heads: a row a stream; waits: what came early, `at` being the stream's place in heads
        heads, waits = map(_load, state.get) if state.exists else (None, None)
        new = [] if state.hasTimedOut else [p[["stream", "seq", "chunk"]] for p in parts]
        now, said, rows = state.getCurrentProcessingTimeMs() if idle_ms is not None else 0, [], waits
        if new:
            new = pd.concat(new, ignore_index=True)
            at, streams = _numbers(None if heads is None else heads["stream"], new["stream"], False)
            then, over, seen = (_grown(None if heads is None else heads[c], len(streams), k) for c, k in (("then", "int64"), ("over", "bool"), ("seen", "int64")))
            seen[at] = now
            rows = pd.concat(([] if waits is None or waits.empty else [waits]) + [pd.DataFrame({"at": at, "seq": new["seq"], "chunk": new["chunk"]})], ignore_index=True)
            rows = rows[(rows["seq"].to_numpy() >= then[rows["at"]]) & ~over[rows["at"]]].drop_duplicates()
            if (twice := rows.duplicated(["at", "seq"], keep=False)).any():  # one number with several texts: the least
                rows = pd.concat([rows[~twice], rows[twice].sort_values("chunk").drop_duplicates(["at", "seq"])])
            rows = rows.sort_values(["at", "seq"], ignore_index=True)
            due = rows["seq"].to_numpy() == then[rows["at"]] + rows.groupby("at").cumcount().to_numpy()
            go, rows = rows[due], rows[~due]
            end = go["chunk"].str.startswith((DONE, ERROR)).astype("bool")
            before = end.astype("int64").groupby(go["at"]).cumsum() - end
            go, end = go[before == 0], end[before == 0]
            then += np.bincount(go["at"], minlength=len(then))
            over[go["at"][end]] = True
            rows = rows[~over[rows["at"]]]
            said = [pd.DataFrame({"stream": streams.take(go["at"]).to_numpy(), "seq": go["seq"].to_numpy(), "chunk": go["chunk"].astype(object).where(~end, None).to_numpy(), "closed": end.to_numpy()}, columns=out)]
            heads = pd.DataFrame({"stream": streams, "then": then, "over": over, "seen": seen})
        if idle_ms is not None and heads is not None:
            gone = heads["seen"].to_numpy() + idle_ms <= now
            broken = gone & ~heads["over"].to_numpy()
            if broken.any():
                late = rows[broken[rows["at"]]].sort_values(["at", "seq"])
                said += [pd.DataFrame({"stream": heads["stream"].take(late["at"]).to_numpy(), "seq": late["seq"].to_numpy(), "chunk": late["chunk"].to_numpy(), "closed": False}), pd.DataFrame({"stream": heads["stream"][broken].to_numpy(), "seq": None, "chunk": None, "closed": True})]
            rows = rows[~gone[rows["at"]]]
            rows, heads = rows.assign(at=(np.cumsum(~gone) - 1)[rows["at"]]), heads[~gone]
        if heads is None or heads.empty:
            if state.exists:
                state.remove()
        else:
            state.update((_pack(heads), _pack(rows)))
            if idle_ms is not None:
                state.setTimeoutDuration(int(max(1, heads["seen"].min() + idle_ms - now)))
        for x in said:
            if len(x):
                yield x.astype({"seq": "Int64", "closed": "bool"})

    rows = chunks.select(F.col(stream).alias("stream"), F.col(seq).cast("long").alias("seq"), F.col(chunk).alias("chunk")).na.drop().withColumn("_state", _share(F.col("stream"), states))
    done = rows.groupBy("_state").applyInPandasWithState(step, f"stream {kind}, seq long, chunk string, closed boolean", "heads binary, waits binary", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return done.withColumnRenamed("stream", stream).withColumnRenamed("seq", seq).withColumnRenamed("chunk", chunk)


def ring(rows: DataFrame, key: str, at: Column, tie: Column, payload: Column, n: int, states: int = STATES) -> DataFrame:
    """(key, version, position, at, tie, payload): the last n rows of each key by (at, tie),
    newest first, whatever the micro-batches. Each batch that touches a key gives its whole
    buffer again under the next version; `newest` keeps the last. The state holds n rows a key.

    at and tie are longs without nulls that tell a key's rows apart (repeated ones count once);
    payload is a string. Keys (not maps) are dealt to `states` states by their hash, since a
    call of Python costs some milliseconds; `states` must stay what it was while a checkpoint is used.
    """
    kind = rows.schema[key].dataType.simpleString()

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # keys: a row a key; have: its last rows, `nr` being the key's place in keys
        keys, have = map(_load, state.get) if state.exists else (None, None)
        known = None if keys is None else keys["key"]
        version, touched, more = _grown(None if keys is None else keys["version"], len(keys) if keys is not None else 0, "int64"), np.zeros(0, "bool"), []

        def cut(have: pd.DataFrame | None, more: list[pd.DataFrame]) -> pd.DataFrame:
            all_ = pd.concat(([] if have is None else [have]) + more, ignore_index=True).drop_duplicates(["nr", "at", "tie"], keep="last")
            all_ = all_.sort_values(["nr", "at", "tie"], ascending=[True, False, False])
            return all_[all_.groupby("nr").cumcount() < n]

        for part in parts:
            nr, known = _numbers(known, part["key"], k[0] is None)
            touched = _grown(touched, len(known), "bool")
            touched[nr] = True
            more.append(pd.DataFrame({"nr": nr, "at": part["at"], "tie": part["tie"], "payload": part["payload"]}))
            if sum(map(len, more)) >= max(CUT_ROWS, 0 if have is None else len(have)):
                have, more = cut(have, more), []
        have = cut(have, more) if more else have
        version = _grown(version, len(known), "int64") + _grown(touched, len(known), "int64")
        state.update((_pack(pd.DataFrame({"key": known, "version": version})), _pack(have)))
        told = have[_grown(touched, len(known), "bool")[have["nr"]]]
        yield pd.DataFrame({"key": known.take(told["nr"]).to_numpy(), "version": version[told["nr"]], "position": told.groupby("nr").cumcount().to_numpy() + 1, "at": told["at"].to_numpy(), "tie": told["tie"].to_numpy(), "payload": told["payload"].to_numpy()})

    few = rows.select(F.col(key).alias("key"), at.cast("long").alias("at"), tie.cast("long").alias("tie"), payload.alias("payload")).withColumn("_state", _share(F.col("key"), states))
    schema = f"key {kind}, version long, position long, at long, tie long, payload string"
    return few.groupBy("_state").applyInPandasWithState(step, schema, "keys binary, have binary", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("key", key)


def newest(buffers: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last version."""
    last = buffers.groupBy(F.col(key).alias("_k")).agg(F.max("version").alias("_v"))
    return buffers.join(last, F.col(key).eqNullSafe(F.col("_k")) & (F.col("version") == F.col("_v"))).drop("_k", "_v")


def replayed(table: DataFrame, files: int = 4, batch_files: int = 1) -> DataFrame:
    """table as a stream: written as `files` lots, of which a micro-batch reads a few. A lot is
    as many files as the session has cores, so that none waits for one task."""
    spark = table.sparkSession
    path, each = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism
    table.repartition(files * each).write.parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", batch_files * each).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now, as a table; its checkpoint stands beside."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
