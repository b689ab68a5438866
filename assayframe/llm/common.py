"""What the operators share: reading a table, narrow columns, the word pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows that a function over texts holds as Python values at a time.
SLICE = 500

#: Arrow types of the columns that functions over texts add.
_ARROW = {
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()),
    "array<struct<start:long,kind:long,end:long>>": pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "kind", "end")])),
    "array<struct<start:long,length:long,period:long>>": pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])),
    "array<struct<start:long,end:long,hit:boolean,view:string>>": pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("hit", pa.bool_()), ("view", pa.string())])
    ),
}


def per_row(df: DataFrame, keep: list[str], sources: list[str], make: Callable[[], Callable], added: dict[str, str]) -> DataFrame:
    """The columns ``keep`` as they are, and columns computed from ``sources`` a slice of rows at a time.

    ``make`` is called once a task and gives a function from one list of values for each source to one list of values for
    each added column (name and type). Kept columns pass as Arrow arrays, so that nulls and large
    numbers among them stay what they are. A source may be a field of a kept struct (``struct.field``)."""
    df = df.select(*dict.fromkeys([*keep, *(s for s in sources if s.split(".")[0] not in keep)]))
    kept = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]
    schema = ", ".join([*kept, *(f"`{n}` {t}" for n, t in added.items())])
    types = [_ARROW[t] for t in added.values()]
    names = [*keep, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                read = []
                for source in sources:
                    name, _, field = source.partition(".")
                    column = part.column(name)
                    read.append((pc.struct_field(column, field) if field else column).to_pylist())
                columns = compute(*read)
                arrays = [part.column(k) for k in keep] + [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, names)
        # workers live on: what this task held is given back before the next stage begins
        del compute
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
