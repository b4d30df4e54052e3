"""Cases that arrive over time: provisional decisions as they come, the corpus-wide pass as a batch job when they are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus, emit, policy
from ..sources.tables import EVIDENCE


def read_arrivals(spark: SparkSession, path: str, *, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVIDENCE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def provisional(evidence: DataFrame, calibration: DataFrame) -> DataFrame:
    """Rows decided without corpus context; works on streams and tables alike."""
    return emit.clamp(emit.output_rows(policy.adjudicate(evidence, calibration)))


def start_provisional(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Appends a provisional row for the first evidence of every case. The case ids seen are the state; a batch that is run again overwrites its own output."""
    rows = provisional(read_arrivals(spark, source).dropDuplicates(["case_id"]), policy.calibration_frame(spark))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{sink.rstrip('/')}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settle(evidence: DataFrame, calibration: DataFrame) -> DataFrame:
    """The final rows of a complete corpus: context, decision, guardrail, priors, clamp, in that order."""
    seen = corpus.apply_context(evidence, corpus.reference_date(evidence), corpus.outlier_sponsors(evidence))
    return emit.clamp(emit.apply_priors(emit.output_rows(policy.guardrail(policy.adjudicate(seen, calibration)))))
