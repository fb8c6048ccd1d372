"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factlens.session import ensure_checkpoint_dir

SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a folder of its own under
    ``spark.checkpoint.dir`` and read again: lineage is cut, every executor
    sees the rows, and several readers share one computation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to write
    (upper and lower case count as equal, as in Spark)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield texts.slice(start)


def struct_udf(schema: StructType, make: Callable[[], Callable[[list], list]]) -> Callable[..., Column]:
    """Arrow function text -> struct.  ``make()`` runs once per task and gives
    a function from a list of texts (None: null) to one list or Arrow array
    per field.  Texts are handed over in slices of bounded size."""
    arrow = pa.struct([(f.name, _arrow(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        for texts in batches:
            for part in slices(texts):
                cols = fn(part.to_pylist())
                cols = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
                yield pa.StructArray.from_arrays(cols, fields=list(arrow))

    return F.arrow_udf(run, schema, F.ArrowUDFType.SCALAR_ITER)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class Shared:
    """A broadcast value and what each worker process builds from it once."""

    _built: dict = {}

    def __init__(self, spark: SparkSession, value):
        self.key, self.sent = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def build(self, make: Callable):
        """``make(value)``, kept in this process until another is built by ``make``."""
        if (had := Shared._built.get(make.__qualname__)) is None or had[0] != self.key:
            had = Shared._built[make.__qualname__] = (self.key, make(self.sent.value))
        return had[1]
