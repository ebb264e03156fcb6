"""Files of the engine: calibration, tensors, recordings, labelled rows, requests as JSON, escalations."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decidra.functions.scores import TEMPERATURES


def load_calibration(spark: SparkSession, path: str) -> dict[str, float]:
    """Temperatures by kind: those of a JSON file (plain, or under "temperatures") over the defaults."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    raw = json.loads(text)
    return {**TEMPERATURES, **{k: float(v) for k, v in raw.get("temperatures", raw).items() if isinstance(v, (int, float))}}


def save_calibration(spark: SparkSession, temperatures: dict[str, float], path: str, **meta: object) -> None:
    """One JSON text with sorted keys, in a folder of any file system the session knows."""
    text = json.dumps({"temperatures": temperatures, **meta}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, dtype, shape array<long>, data binary): the tensors of safetensors files; metadata entries are left out.

    A file is one row of the source, so files should be of a size that a task can hold.
    """

    def split(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                (n,) = struct.unpack("<Q", content[:8])
                for name, spec in json.loads(content[8 : 8 + n]).items():
                    if name != "__metadata__":
                        a, b = spec["data_offsets"]
                        rows.append((file, name, spec["dtype"], spec["shape"], content[8 + n + a : 8 + n + b]))
            yield pd.DataFrame(rows, columns=["file", "name", "dtype", "shape", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(split, "file string, name string, dtype string, shape array<long>, data binary")


#: A request as JSON: one question by name each, as text that the questions' reader takes apart.
BODY = "model string, state string, questions map<string,string>, assets map<string,string>"


def json_requests(rows: DataFrame, body: str, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, questions, errors) of request bodies in JSON; a body that is none gives one error row and no request."""
    text = F.col(body)
    parsed = rows.select(F.col(id_col).alias("request_id"), text.alias("_b"), F.from_json(text, BODY).alias("_r"), F.json_object_keys(text).alias("_k"))
    bad = parsed.where("_k is null").select("request_id", F.struct(F.array(F.lit("body")).alias("loc"), F.lit("body is no JSON object").alias("msg"), F.lit("json_invalid").alias("type")).alias("error"))
    good = parsed.where("_k is not null")
    state = F.get_json_object("_b", "$.state")
    kind = F.when(state.isNull(), None).when(F.json_array_length(state).isNotNull(), "array").when(F.json_object_keys(state).isNotNull(), "object").otherwise("text")
    requests = good.select("request_id", F.col("_r.model").alias("model"), kind.alias("state_kind"), state.alias("state"), F.to_json("_r.assets").alias("assets"))
    names = F.json_object_keys(F.get_json_object("_b", "$.questions"))
    each = good.select("request_id", F.posexplode(names).alias("pos", "qname"), F.col("_r.questions").alias("_q")).withColumn("_one", F.col("_q")[F.col("qname")])
    part = lambda p: F.get_json_object("_one", p)
    questions = each.select("request_id", "pos", "qname", part("$.type").alias("qtype"), part("$.instructions").alias("instructions"), part("$.criteria").alias("criteria"))
    return requests, questions, bad


def record(steps: DataFrame, path: str, partitions: int = 1) -> None:
    """Writes steps as JSON lines."""
    steps.repartition(partitions, "run").sortWithinPartitions("run", "step").write.mode("overwrite").json(path)


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The recorded steps, checked: adds ``gap`` (a step is missing before this one) and ``broken`` (its state is not where the one before ended).

    The schema needs run, step, before and after. A run is in the order of its steps in one window, which spills.
    """
    rows = spark.read.schema(schema).json(path)
    own = Window.partitionBy("run").orderBy("step")
    last, left = F.lag("step").over(own), F.lag("after").over(own)
    return rows.select("*", F.coalesce(F.col("step") != last + 1, F.col("step") != 0).alias("gap"), F.coalesce(~F.col("before").eqNullSafe(left) & last.isNotNull(), F.lit(False)).alias("broken"))


def labelled(spark: SparkSession, path: str, text: str, label: str, id_col: str, rows: int, seed: int = 0, where: Column | None = None) -> DataFrame:
    """(id, text, label): about so many rows of a labelled table, by hash of id and seed: the same ones on every run and cluster."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    kept = df.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(label).alias("label"), order.alias("_o"))
    return kept.orderBy("_o", "id").limit(rows).drop("_o")


def send_escalations(escalations: DataFrame, send: Callable[[list[dict]], None], checkpoint: str):
    """Starts a stream that hands each micro-batch of escalations to ``send``, partition by partition on the executors."""

    def each(batch: DataFrame, _: int) -> None:
        batch.foreachPartition(lambda rows: send([r.asDict() for r in rows]))

    return escalations.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def local_path(path: str) -> str:
    """A file URL of a local path, for sessions whose default file system is another."""
    return path if "://" in path else f"file://{os.path.abspath(path)}"
