"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumframe.operators.skew import hot_join
from quorumframe.storage import materialise, new_path, shared_dir, spread

__all__ = ["hot_join", "materialise", "new_path", "session", "shared_dir", "spans_text", "table"]

#: Bounds one Arrow batch of texts, whatever the length of its rows.
BATCH_BYTES = "8m"


def session(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches bounded by bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one of too few partitions for the cores there are is spread over them."""
    return spread(session(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of an array of structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
