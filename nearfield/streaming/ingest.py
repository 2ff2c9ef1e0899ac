"""Structured Streaming: a stream of (op, vec_id, embedding, seq) kept applied to an index, micro-batch by micro-batch.

Within a batch the last operation on an id counts (by `seq`). An append of an id that the index has replaces its vector. A batch
changes the index with one write of its metadata, which also notes the batch's number: a batch that runs again after a failure
is known by it and changes nothing, and what a failed run wrote is never read.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators import maintain
from nearfield.operators.index import VectorIndex


def apply_batch(index: VectorIndex, batch: DataFrame, rebalance: bool = True, batch_id: int | None = None, stream: str = "changes") -> None:
    """op is "append" or "delete"; embedding is null for deletes. Without batch_id the batch is applied whatever came before."""
    applied = index.meta["applied"]
    if batch_id is not None and applied.get(stream, -1) >= batch_id:
        return
    last = batch.groupBy("vec_id").agg(F.max_by(F.struct("op", "embedding"), "seq").alias("last")).select("vec_id", "last.*").persist()
    before = copy.deepcopy(index.meta)
    try:
        maintain.delete(index, last.select("vec_id"), missing="ignore", rebalance_after=False, commit=False)
        new = last.filter("op = 'append'").select("vec_id", "embedding")
        if not new.isEmpty():
            maintain.append(index, new, rebalance_after=False, commit=False)
        if batch_id is not None:
            index.meta["applied"] = {**applied, stream: batch_id}
        index._commit()
    except BaseException:
        index.meta = before
        raise
    finally:
        last.unpersist()
    if rebalance:
        maintain.rebalance(index)


def maintain_stream(index: VectorIndex, changes: DataFrame, checkpoint: str, stream: str = "changes", **trigger) -> StreamingQuery:
    """Start applying changes(op, vec_id, embedding, seq). One writer an index; `stream` names the checkpoint's stream in it."""
    return changes.writeStream.foreachBatch(lambda batch, i: apply_batch(index, batch, batch_id=i, stream=stream)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
