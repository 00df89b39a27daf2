"""What the corpus operators share: tables, shared storage, the held-out rule."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, from ``spark.checkpoint.dir``. Only a local session, where driver and
    executors are one process, gets a folder of its own when the setting is missing."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Paths of the tables that open scratch blocks have cut.
_open: list[list[str]] = []


#: Spark's own switch for dropping the shuffle files of a query at its end.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, keep: bool = False, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on the
    executors that made it. Inside a ``scratch`` block the table goes at its end, unless it is to ``keep``. ``free`` has
    Spark drop the step's shuffle files once the table is written, and not whenever their plans are collected."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    if _open and not keep:
        _open[-1].append(path)
    before = spark.conf.get(_FREE, "false")
    try:
        if free:
            spark.conf.set(_FREE, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(_FREE, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables cut inside, which nothing that goes on may read, and has Spark drop their steps' shuffle files."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        tidy(spark)


def tidy(spark: SparkSession) -> None:
    """Has Spark's cleaner drop the shuffle files of steps that are over: it does so when their plans are collected."""
    spark._jvm.System.gc()


#: Rows of an Arrow batch that are Python objects at once.
_ROWS = 256


def by_text(kind: T.DataType, of: Callable[[list[str | None]], Sequence], text: Column) -> Column:
    """Values of ``kind`` that a function of many texts gives, one a text. Texts are turned into Python strings a few at a time."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [pa.array(of(batch.slice(at, _ROWS).to_pylist()), arrow) for at in range(0, len(batch), _ROWS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    return over(text)


def sized(df: DataFrame, most: int) -> DataFrame:
    """``df``, a stored table, marked to be sent to every executor if it has ``most`` rows or fewer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b) is connected with. Rounds of taking the least
    label among neighbours, each followed by taking over the label's own label, until nothing changes."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    both = cut(both, "edges")
    labels = cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label")
        best = seen.union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        # Only labels that have a lower label themselves are looked up.
        ends = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = best.join(ends, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        old = labels.withColumnRenamed("label", "was")
        new = cut(new.join(old, "node").select("node", "label", (F.col("label") != F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Matches that are counted up together in ``matches``.
_RUN = 128


def matches(text: Column, pattern: Column, make: Callable[[Column, Column, Column, Column, Column], Column], kind: str, moved: Sequence[str]) -> Column:
    """Array of ``make(start, end, match, before, after)``, structs of type ``kind``, over the matches of a pattern that
    never matches nothing; before and after are the stretches up to the neighbouring matches. ``moved`` names the
    fields that hold places. Places are counted up in runs of matches that are then moved on together, so that a text
    full of matches takes little more than one pass."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(make(start, end, x["m"], x["b"], x["a"]))).alias("out"))

    def run_on(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("by"), x["out"].alias("out")))).alias("out"))

    def move(run: Column) -> Column:
        def one(x: Column) -> Column:
            for name in moved:
                x = x.withField(name, x[name] + run["by"])
            return x

        return F.transform(run["out"], one)

    def of(parts: Column) -> Column:
        heads = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(heads, lambda h: F.aggregate(F.slice(parts, h * _RUN + 1, F.lit(_RUN)), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<by:int,out:array<{kind}>>>").alias("out"))
        return F.flatten(F.transform(F.aggregate(runs, first, run_on, lambda acc: acc["out"]), move))

    # An array of one, transformed, is a name for its element: the expressions are evaluated once.
    zipped = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b"), F.slice(between, F.lit(2), F.size(found)).alias("a"))
    return F.get(F.transform(F.array(zipped), of), 0)
