"""Tables that grow by named batches, each published as a whole and exactly once: a batch written again takes the place of itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import files

#: Where the names of published folders stand, a small file per batch.
MARKS = "_published"


def publish(df: DataFrame, path: str, batch: int | str, fmt: str = "parquet", by: tuple[str, ...] = (), codec: str | None = None) -> None:
    """Writes df as a batch of the table at path, compressed by codec or as the session has it. Readers see it, all of it, once its mark is there; a batch of this name from before is gone then."""
    name = batch if isinstance(batch, str) else f"{batch:012d}"
    folder = f"batch={name}-{uuid.uuid4().hex[:12]}"
    df.write.format(fmt).options(**({"compression": codec} if codec else {})).partitionBy(*by).save(f"{path}/{folder}")
    before = files.get(f"{path}/{MARKS}/{name}")
    files.put(f"{path}/{MARKS}/{name}", folder.encode())
    if before is not None:
        files.drop(f"{path}/{before.decode()}")


def batches(path: str) -> dict[str, str]:
    """Folders of the published batches by name."""
    return {name: files.get(f"{path}/{MARKS}/{name}").decode() for name in files.names(f"{path}/{MARKS}") if not name.startswith("_")}


def published(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", last: bool = False) -> DataFrame:
    """The rows of all published batches (or of the last one) in one scan, each with its batch's name in `batch`."""
    found = batches(path)
    folders = [folder for _, folder in sorted(found.items())[-1 if last else 0 :]]
    if not folders:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(""))
    wide = StructType([*schema.fields, StructField("batch", StringType())])
    rows = spark.read.schema(wide).format(fmt).option("basePath", path).load([f"{path}/{folder}" for folder in folders])
    return rows.withColumn("batch", F.regexp_replace("batch", "-[0-9a-f]{12}$", "")).select(*schema.names, "batch")
