"""M3: continuous reduction — every micro-batch of tool results runs the result-level
job, writes its reduced blocks (overwritten if the batch is replayed) and appends its events to the event
log (once per batch, by the log's ledger)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import event_log as EL
from ..operators import report as RP
from ..operators import results as RS

#: Input files of a micro-batch, at most: each batch has its own jobs, writes and ledger row, which cost the same for any size.
FILES_A_BATCH = 16


def reduce_stream(blocks: DataFrame, cfg: Config, log_path: str, checkpoint: str, trigger_once: bool = True,
                  blocks_path: str | None = None):
    """Start the stream; returns the StreamingQuery. ``blocks`` is a stream of block rows. With
    ``blocks_path`` the final blocks of every result are written there."""

    def batch(df: DataFrame, batch_id: int) -> None:
        started = time.time()
        summary, reduced = RS.reduce_results(df, cfg, materialize=True)
        if blocks_path:
            final = RS.final_blocks(reduced, summary).withColumn("batch_id", F.lit(batch_id))
            (final.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(blocks_path))
        EL.append(RP.events_from_results(summary), log_path, str(batch_id), started)
        EL.merge(df.sparkSession, log_path)

    w = blocks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()
