"""Conversation digests and bounded memories kept up to date from message streams."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.functions import vocabulary as V
from marginalia.operators.memory import DIGEST_CHARS, HISTORY, enforce_capacity
from marginalia.streaming.tables import use_keyed_state

EVERY = 5
_OUTPUT = "conversation_id BIGINT, message_count BIGINT, digest STRING, created_at TIMESTAMP"
_STATE = "n BIGINT, ids ARRAY<BIGINT>, lines ARRAY<STRING>"


def _advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, ids, lines = state.get if state.exists else (0, [], [])
    ids, lines = list(ids), list(lines)
    out = []
    # A batch's messages of one conversation are put in time order; their contents are cut first.
    pending = [pdf.assign(content=pdf["content"].fillna("").str.slice(0, DIGEST_CHARS)) for pdf in batches if len(pdf)]
    rows = pd.concat(pending).sort_values(["created_at", "id"]) if pending else pd.DataFrame()
    for row in rows.itertuples():
        count += 1
        ids.append(int(row.id))
        lines.append(f"{row.role}: {row.content}")
        del ids[:-HISTORY], lines[:-HISTORY]
        if count % EVERY == 0:
            out.append((key[0], count, "\n".join(lines), row.created_at))
    state.update((count, ids, lines))
    yield pd.DataFrame(out, columns=["conversation_id", "message_count", "digest", "created_at"])


def digest_stream(messages: DataFrame) -> DataFrame:
    """Digest of the last ten messages on every fifth message of a conversation.

    State per conversation: the count and ten lines. Messages of a batch are taken in time order, so a conversation's messages of
    one micro-batch, each cut to what a digest shows, are held together; ``maxFilesPerTrigger`` bounds them. ``created_at``
    is the time of the fifth message.
    """
    return (messages.select("conversation_id", "id", "role", "content", "created_at")
            .groupBy("conversation_id")
            .applyInPandasWithState(_advance, _OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout))


MEMORY_COLUMNS = "id BIGINT, memory_type STRING, content STRING, source_conversation_id BIGINT, importance INT, created_at TIMESTAMP"
CHANGES = f"{MEMORY_COLUMNS}, change STRING, most INT"
SALTS = 16


class BoundedMemories(StatefulProcessor):
    """The best rows of one part of a memory type: what enters them and what they push out, as changes.

    The state holds the order values of at most the type's limit of rows; types without a limit only remember the ids
    they had. A row sent again, in this batch or a later one, changes nothing.
    """

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id BIGINT", "importance INT, created_at TIMESTAMP")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit = self.limits.get(key[0]) or 0
        if limit <= 0:
            for batch in rows:
                fresh = [not self.held.containsKey((int(i),)) for i in batch["id"]]
                added = batch[fresh].drop_duplicates("id")
                for i in added["id"]:
                    self.held.updateValue((int(i),), (0, None))
                yield added.drop(columns=["salt"]).assign(change="add", most=0)
            return
        before = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        order = lambda i, importance, created: ((0 if key[0] == "short_term" or importance is None else importance), created, i)
        best = {i: (order(i, *v), None) for i, v in before.items()}
        for batch in rows:
            for row in batch.itertuples(index=False):
                if int(row.id) not in best:
                    importance = None if pd.isna(row.importance) else int(row.importance)
                    best[int(row.id)] = (order(int(row.id), importance, row.created_at.to_pydatetime()), (row, importance))
            best = dict(sorted(best.items(), key=lambda item: item[1][0], reverse=True)[:limit])
        changes = []
        for i in before.keys() - best.keys():
            self.held.removeKey((i,))
            changes.append((i, key[0], None, None, None, None, "evict", limit))
        for i, (_, new) in best.items():
            if new is not None:
                row, importance = new
                self.held.updateValue((i,), (importance, row.created_at.to_pydatetime()))
                changes.append((i, key[0], row.content, row.source_conversation_id, importance, row.created_at, "add", limit))
        out = pd.DataFrame(changes, columns=[*(c.split()[0] for c in MEMORY_COLUMNS.split(", ")), "change", "most"])
        yield out.astype({"source_conversation_id": "Int64", "importance": "Int32"})

    def close(self) -> None:
        pass


def memory_changes(arrivals: DataFrame, limits: dict[str, int] | None = None, salts: int = SALTS) -> DataFrame:
    """Stream of changes (``add``, ``evict``) to the memory table. Blank contents and rows without an id or time are left out.

    A type is spread over ``salts`` parts by the hash of the id, each with the type's whole limit, so no task sees a whole type;
    the reader cuts the parts' best rows to the limit.
    """
    use_keyed_state(arrivals.sparkSession)
    limits = {**V.MEMORY_LIMITS, **(limits or {})}
    conversation = F.col("source_conversation_id") if "source_conversation_id" in arrivals.columns else F.lit(None)
    rows = arrivals.filter((F.length(F.trim(F.coalesce("content", F.lit("")))) > 0) & F.col("id").isNotNull() & F.col("created_at").isNotNull())
    rows = rows.select("id", "memory_type", "content", conversation.cast("bigint").alias("source_conversation_id"), F.col("importance").cast("int").alias("importance"),
                       "created_at", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    return rows.groupBy("memory_type", "salt").transformWithStateInPandas(BoundedMemories(limits), CHANGES, "Append", "None")


def memory_stream(arrivals: DataFrame, root: str, checkpoint: str, limits: dict[str, int] | None = None, salts: int = SALTS):
    """Keep a log of the changes under ``root``, a folder a batch; a replayed batch writes its folder anew, nothing else is rewritten."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(root, f"batch_id={batch_id}"))
    return (memory_changes(arrivals, limits, salts).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_memory(spark, root: str, limits: dict[str, int] | None = None) -> DataFrame:
    """The memory table: rows that were added and not pushed out, cut over all parts to the limits the stream had, or other ones."""
    log = spark.read.schema(CHANGES).option("recursiveFileLookup", True).parquet(root)
    if limits is None:  # a row per type with a limit
        limits = {r[0]: r[1] for r in log.filter("most > 0").groupBy("memory_type").agg(F.max("most")).collect()}
        limits = dict.fromkeys(V.MEMORY_LIMITS, 0) | limits
    gone = log.filter("change = 'evict'").select("id", "memory_type")
    return enforce_capacity(log.filter("change = 'add'").drop("change", "most").join(gone, ["id", "memory_type"], "left_anti"), limits)


def short_term_upserts(store: DataFrame, digests: DataFrame, limit: int | None = None) -> DataFrame:
    """The short-term memories after a batch of digests ``(conversation_id, message_count, digest, created_at)``.

    ``store(source_conversation_id, content, created_at)`` has a row per conversation, at most ``limit``. In time order a digest
    replaces the content of its conversation's row, which keeps its time, or adds a row and pushes out the oldest beyond the limit.
    Whether a digest finds a row depends on all before it, so a batch is one sequence; batches bound its length.
    """
    limit = V.MEMORY_LIMITS["short_term"] if limit is None else limit
    events = store.select("source_conversation_id", "content", "created_at", F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("message_count")).unionByName(
        digests.filter("digest <> ''").select(F.col("conversation_id").alias("source_conversation_id"), F.col("digest").alias("content"), "created_at", F.lit(1).alias("step"), "message_count"))

    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list] = {}
        for r in rows.sort_values(["step", "created_at", "source_conversation_id", "message_count"]).itertuples(index=False):
            if r.source_conversation_id in held:
                held[r.source_conversation_id][0] = r.content
            else:
                held[r.source_conversation_id] = [r.content, r.created_at]
                if 0 < limit < len(held):
                    del held[min(held, key=lambda c: (held[c][1], c))]
        return pd.DataFrame([(c, *v) for c, v in held.items()], columns=["source_conversation_id", "content", "created_at"])

    return events.withColumn("whole", F.lit(1)).groupBy("whole").applyInPandas(apply, "source_conversation_id BIGINT, content STRING, created_at TIMESTAMP")


def short_term_stream(messages: DataFrame, root: str, checkpoint: str, limit: int | None = None):
    """Short-term memories kept from a stream of messages: a digest on every fifth message updates its conversation's row.

    A batch reads the version before it, a bounded number of rows, and writes its own, so a replay gives the same.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = [v for v in _versions(spark, root) if v <= batch_id]
        schema = "source_conversation_id BIGINT, content STRING, created_at TIMESTAMP"
        store = spark.read.schema(schema).parquet(os.path.join(root, f"version={max(previous)}")) if previous else spark.createDataFrame([], schema)
        short_term_upserts(store, batch, limit).coalesce(1).write.mode("overwrite").parquet(os.path.join(root, f"version={batch_id + 1}"))
    return digest_stream(messages).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, root: str) -> list[int]:
    """Versions that were written to the end."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return [int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]


def read_short_term(spark, root: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, f"version={max(_versions(spark, root))}"))
