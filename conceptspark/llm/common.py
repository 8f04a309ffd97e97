"""What the operators of this subpackage share: text batches, scratch tables and tokenizer files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptspark.session import scratch_path


SLICE = 500


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks (executors ask for themselves)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh Parquet table in the shared folder and go on from the written copy.

    The copy cuts the lineage, survives lost executors and is read with column pruning.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_text(
    docs: DataFrame, make: Callable[[], Callable], fields: list[T.StructField], text_col: str, keep: list[str]
) -> DataFrame:
    """The columns ``keep`` of ``docs`` followed by ``fields``, computed in Arrow batches from whole texts.

    ``make()`` runs once per task and returns ``work(texts) -> list of value lists``, one list per field. Texts
    are str or None. Columns of ``docs`` that are not kept do not reach Python, so their names cannot clash;
    a kept column with the name of a field is replaced by the field.
    """
    names = {f.name for f in fields}
    kept = [c for c in keep if c not in names]
    text = "text_in"
    while text in kept:
        text += "_"
    picked = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = T.StructType([*(picked.schema[c] for c in kept), *fields])
    types = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole):
                values = work(batch.column(batch.num_columns - 1).to_pylist())
                columns = [*batch.columns[:-1], *(pa.array(v, t) for v, t in zip(values, types, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return picked.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a few rows, so that Python objects are made of few texts at a time."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    plain = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(),
        T.StringType(): pa.string(), T.BinaryType(): pa.binary(),
    }
    return pa.list_(plain[kind.elementType]) if isinstance(kind, T.ArrayType) else plain[kind]


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
