"""Thinning and streaming queries."""

import uuid

from pyspark.sql import functions as F

from tracklab.catalog.commands import SK, STREAM, _streams
from tracklab.catalog.comparison import positions
from tracklab.catalog.series import manifest
from tracklab.operators import subsample
from tracklab.plans.registry import query
from tracklab.session import scratch_folder
from tracklab.streaming.commands import stream_commands, with_gains


@query(
    "C10_greedy_subsample",
    """SELECT rec, i FROM (WITH RECURSIVE m AS (SELECT rec, i, x, y FROM v_manifest WHERE eligible),
         nx AS (SELECT a.rec, a.i, min(b.i) AS j FROM m a JOIN m b ON a.rec = b.rec AND b.i > a.i
           AND sqrt(power(b.x - a.x, 2) + power(b.y - a.y, 2)) >= 1.5 GROUP BY a.rec, a.i),
         kept AS (SELECT rec, min(i) AS i FROM m GROUP BY rec UNION ALL SELECT k.rec, nx.j FROM kept k JOIN nx ON nx.rec = k.rec AND nx.i = k.i)
       SELECT rec, i FROM kept)""",
    ("v_manifest",),
)
def greedy_subsample(spark, sf):
    m, _ = manifest(spark, sf)
    return subsample.greedy_subsample(m.where("eligible"), ["rec"])


@query(
    "C11_greedy_arc",
    """SELECT rec, run, i FROM (WITH RECURSIVE nx AS (SELECT a.rec, a.run, a.i, min(b.i) AS j FROM v_pos a JOIN v_pos b
           ON a.rec = b.rec AND a.run = b.run AND b.i > a.i AND abs(b.pos - a.pos) >= 1.5 GROUP BY a.rec, a.run, a.i),
         kept AS (SELECT rec, run, min(i) AS i FROM v_pos GROUP BY rec, run
           UNION ALL SELECT k.rec, k.run, nx.j FROM kept k JOIN nx ON nx.rec = k.rec AND nx.run = k.run AND nx.i = k.i)
       SELECT rec, run, i FROM kept)""",
    ("v_pos",),
)
def greedy_arc(spark, sf):
    return subsample.greedy_arc(positions(spark, sf)[0], ["rec", "run"])


@query(
    "S1_stream_commands",
    f"""SELECT {SK}, i, hold_reason, hold_run, last_valid_i, round(omega_cmd, 9) AS omega_cmd, round(omega_cmd_ramp, 9) AS omega_cmd_ramp,
          CAST(saturated AS INT) AS saturated, 0 AS late_dropped FROM v_ramp""",
    ("v_ramp",),
)
def stream(spark, sf):
    s, gains, _ = _streams(spark, sf)
    at = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    with_gains(s, gains).write.parquet(f"{at}/in")
    src = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
    run = (
        stream_commands(src)
        .writeStream.format("parquet")
        .option("path", f"{at}/out")
        .option("checkpointLocation", f"{at}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    got = spark.read.parquet(f"{at}/out")
    return got.select(
        *STREAM, "i", "hold_reason", "hold_run", "last_valid_i",
        F.round("omega_cmd", 9).alias("omega_cmd"), F.round("omega_cmd_ramp", 9).alias("omega_cmd_ramp"),
        F.col("saturated").cast("int").alias("saturated"), F.col("late_dropped").cast("int").alias("late_dropped"),
    )
