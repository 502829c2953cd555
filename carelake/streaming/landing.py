"""New landing files trigger staging and the load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from carelake.plans.etl import Etl
from carelake.schemas import ENTITIES
from carelake.sources.landing import bad_lines, csv_reader, stage


def landing_stream(spark: SparkSession, landing: str, checkpoint: str, etl: Etl, as_of,
                   loaded_at: str | None = None) -> DataFrame:
    """Stage every file that is new since the last call, then run the load.

    Each micro-batch is stored under its stream's id and its number and replaces
    itself when it is replayed, and facts skip known ids, so a restart loads
    nothing twice; a new checkpoint is a new stream with batches of its own.
    Lines that cannot be parsed are refused, not staged.
    """
    queries = []
    for entity in ENTITIES:
        files = csv_reader(spark.readStream, entity).csv(f"{landing.rstrip('/')}/{entity}")

        def keep(batch: DataFrame, number: int, entity: str = entity) -> None:
            if not batch.isEmpty():
                stream = spark.read.json(f"{checkpoint.rstrip('/')}/{entity}/metadata").first()["id"]
                name = f"stream-{stream}-{number:09d}"
                etl.staging.reject(bad_lines(batch, entity), entity, name, "bad line")
                etl.staging.add(stage(batch, entity, loaded_at=loaded_at), entity, name)

        queries.append(files.select("*", "_metadata").writeStream.foreachBatch(keep)
                       .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{entity}")
                       .trigger(availableNow=True).start())
    for query in queries:
        query.awaitTermination()
    return etl.run_all(as_of)
