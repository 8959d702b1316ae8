"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bits of the filter that spares rows which a join would drop; a full filter drops nothing.
FILTER_BITS = 1 << 24
#: Words of a text as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from the driver's own place.

    On a cluster where that place is not shared, ship the package with
    ``--py-files``; the extra path then does no harm.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that ``spark.checkpoint.dir`` names.

    Where none is set, as in tests on one machine, a temporary one is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get("spark.checkpoint.dir")
        if not configured and not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share.")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Writes the rows to the cluster's shared checkpoint folder and cuts the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Like :func:`durable`, as a compressed Parquet table, for wide rows whose columns are read apart; and its place."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.parquet(place), place


def discard(spark: SparkSession, *places: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def perhaps(column: Column, wanted: DataFrame, bits: int = FILTER_BITS) -> Column:
    """Whether a long may be among those of the one column of ``wanted``: no false negatives, few false positives."""
    place = lambda c: F.pmod(c, F.lit(bits))
    word = lambda c: F.shiftright(place(c), 6).cast("int")
    bit = lambda c: (place(c) % 64).cast("int")
    one = F.col(wanted.columns[0])
    set_words = wanted.select(word(one).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(one)).alias("bits"))
    blank = wanted.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("bits"))
    words = set_words.unionByName(blank).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    marks = durable(words.agg(F.sort_array(F.collect_list(F.struct("at", "bits"))).getField("bits").alias("marks")))
    return F.call_function("shiftright", F.get(marks.scalar(), word(column)), bit(column)).bitwiseAND(F.lit(1)) == 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (src, dst long): node, component (smallest node).

    Each round points every node at its smallest smaller neighbour, follows those
    pointers four steps and contracts the edges to where they lead, until no edge
    is left. Pointers are edges themselves, so a chain that four steps do not
    finish stays connected for the next round; the rounds follow the logarithm of
    the longest chain. A component of any size stays spread over the partitions,
    and nothing but the number of edges left reaches the driver. Edges with a
    null end are ignored; a self loop gives its node a row.
    """
    both = durable(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"))
    label = durable(both.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    links = durable(
        both.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct()
    )
    label = label.select("node", F.col("node").alias("component"))
    while not links.isEmpty():
        point = links.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("y"))
        for _ in range(2):
            onward = point.select(F.col("x").alias("y"), F.col("y").alias("z"))
            point = point.join(onward, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        point = durable(point)

        def led(df: DataFrame, column: str, point: DataFrame = point) -> DataFrame:
            to = point.select(F.col("x").alias(column), F.col("y").alias("_to"))
            return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        links = led(led(links, "a"), "b").where("a <> b")
        links = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        label = durable(led(label, "component").select("node", "component"))
    return label
