"""Recommendations for prompts as they arrive, over a static collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkrec import schemas
from sparkrec.config import DEFAULTS, Params
from sparkrec.operators.filters import split_prompts
from sparkrec.plans.recommend import Run, failed_events, run_pipeline, stage_events
from sparkrec.sources.prompts import identified
from sparkrec.storage import cut_lineage, delete_path, intermediates

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def append_batches(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append",
                   work: Callable[[DataFrame, int], DataFrame] | None = None, late_path: str | None = None,
                   **trigger) -> StreamingQuery:
    """Write each micro-batch into its own folder below `path`. A batch that runs
    again after a failure replaces its folder, so nothing is stored twice. With `late_path`
    rows that the stream marks as `late` go to a table of their own there."""

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = work(batch, batch_id) if work else batch
        if late_path is None:
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")
            return
        with intermediates(rows.sparkSession):
            rows = cut_lineage(rows, "batch")  # the state is asked once
            rows.where("NOT late").drop("late").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")
            rows.where("late").drop("late").write.mode("overwrite").option("compression", "zstd").parquet(f"{late_path}/batch_id={batch_id}")

    return (stream.writeStream.outputMode(mode).foreachBatch(store)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def recommend_stream(
    queries: DataFrame,
    collection: DataFrame,
    model: Callable,
    results_path: str,
    events_path: str,
    checkpoint: str,
    params: Params = DEFAULTS,
    *,
    prepare: Callable[[DataFrame], dict] | None = None,
    on_run: Callable[[Run, int], None] | None = None,
    on_stage: Callable[[str, Run, int], None] | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Run the pipeline on each micro-batch of (query_id, text, ...).

    Results and rejected prompts go to a folder per micro-batch, events to a folder per
    micro-batch and stage, written when the stage ends: a reader sees how far a batch has
    come while it runs. Where a run fails, an error event per request follows those of the
    stages before, and the stream ends with the failure; the batch is run anew, and its
    events replaced, when the stream starts again. Requests without a query_id get one.
    Intermediate tables of a batch are deleted after it. `prepare` may return options that
    depend on the batch, such as its variants. `on_stage` is called after the events of a
    stage are written.
    """

    def serve(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{events_path}/batch_id={batch_id}"
        told: list[str] = []

        def tell(stage: str, run: Run) -> None:
            path = f"{folder}/stage={stage}"
            stage_events(stage, run).write.mode("overwrite").option("compression", "zstd").parquet(path)
            told.append(path)
            if on_stage:
                on_stage(stage, run, batch_id)

        with intermediates(spark):
            delete_path(spark, folder)
            batch = identified(cut_lineage(batch, "batch"), batch_id)
            accepted, rejected = split_prompts(batch)
            rejected.write.mode("overwrite").option("compression", "zstd").parquet(f"{events_path}-rejected/batch_id={batch_id}")
            try:
                extra = prepare(accepted) if prepare else {}
                run = run_pipeline(accepted, collection, model, params, on_stage=tell, **options, **extra)
                run.results.write.mode("overwrite").option("compression", "zstd").parquet(f"{results_path}/batch_id={batch_id}")
            except Exception as exc:
                before = spark.read.schema(schemas.EVENTS).parquet(*told) if told else None
                failed_events(accepted, str(exc), before).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/stage=error")
                raise
            if on_run:
                on_run(run, batch_id)

    return (queries.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
