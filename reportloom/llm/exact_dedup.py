"""Exact dedup by composable polynomial fingerprints.

A text's fingerprint is the value of the polynomial that its bytes are the coefficients
of, at a fixed place, modulo two primes. Chunks are hashed apart: a chunk of n bytes is
the pair (its hash, the place to the power n), and pairs compose by
``(h, s) . (g, t) = (h * t + g, s * t)``, whatever the cuts. So a huge document is many
chunk rows that any tasks hash, and the fingerprint of the whole is put together from
them. Texts of one fingerprint are then compared chunk by chunk: a chunk number whose
least and greatest chunks are equal holds one chunk only. Fingerprints that fail this are
told apart by their chunks themselves, so the result doesn't rest on the hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import discard, durable, perhaps, ship, stored, sweep, table

#: Two primes under 2^31 and a place for each: products of two residues fit a long.
PRIMES = (2_147_483_647, 2_147_483_629)
PLACES = (1_340_157_138, 912_840_173)
#: Characters of a chunk, and bytes that are hashed together.
CHUNK, TOGETHER = 1 << 15, 1 << 20
FINGERPRINT = ["n_bytes", "h0", "h1"]


def normal(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def powers(place: int, prime: int, n: int) -> np.ndarray:
    """place^0 .. place^(n - 1) modulo the prime, by doubling."""
    out = np.ones(max(1, n), dtype=np.int64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * pow(place, done, prime) % prime
        done += more
    return out


def chunk_hashes(data: np.ndarray, ends: np.ndarray, primes: tuple[int, ...], places: tuple[int, ...]) -> list[np.ndarray]:
    """For chunks that stand one after the other in ``data``: hash and shift for each prime."""
    size = np.diff(np.r_[0, ends])
    power = [powers(b, p, int(size.max(initial=0)) + 1) for p, b in zip(primes, places, strict=True)]
    out = [np.zeros((2, len(size)), dtype=np.int64) for _ in primes]
    at = 0
    while at < len(size):
        begin = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, begin + TOGETHER, side="right")))
        part = data[begin : ends[to - 1]].astype(np.int64) + 1  # no byte is a zero coefficient
        left = np.repeat(ends[at:to], size[at:to]) - np.arange(begin, ends[to - 1]) - 1
        filled = np.flatnonzero(size[at:to])
        for k, prime in enumerate(primes):
            if len(filled):  # a chunk's sum is below 2^8 * 2^31 * its bytes
                out[k][0, at + filled] = np.add.reduceat(part * power[k][left], (ends[at:to] - size[at:to] - begin)[filled]) % prime
            out[k][1, at:to] = power[k][size[at:to]]
        at = to
    return [row for pair in out for row in pair]


def hashed(chunks: DataFrame, primes: tuple[int, ...], places: tuple[int, ...]) -> DataFrame:
    """The chunks with their bytes, hashes and shifts instead of their characters."""
    columns = [c for c in chunks.columns if c != "chunk"]

    def run(batches):
        for batch in batches:
            column = batch.column("chunk").cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))
            data = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
            values = chunk_hashes(data, ends, primes, places)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, columns), pa.array(np.diff(np.r_[0, ends])), *map(pa.array, values)],
                [*columns, "bytes", "h0", "s0", "h1", "s1"],
            )

    own = [f"{c} {chunks.schema[c].dataType.simpleString()}" for c in columns]
    return chunks.mapInArrow(run, ", ".join([*own, "bytes long, h0 long, s0 long, h1 long, s1 long"]))


def composed(chunks: DataFrame, primes: tuple[int, ...]) -> DataFrame:
    """(uid, id, sha, n_bytes, h0, h1): texts of one chunk as they are, those of several put together in their order."""
    columns = ["uid", "id", "sha"]
    empty = F.struct(*(F.lit(x).cast("long").alias(n) for n, x in (("n", 0), ("h0", 0), ("h1", 0))))

    def add(left: Column, right: Column) -> Column:
        both = ((left[f"h{k}"] * right[f"s{k}"] + right[f"h{k}"]) % p for k, p in enumerate(primes))
        return F.struct((left["n"] + right["bytes"]).alias("n"), *(h.alias(f"h{k}") for k, h in enumerate(both)))

    parts = F.sort_array(F.collect_list(F.struct("part", "bytes", "h0", "s0", "h1", "s1")))
    whole = chunks.where("parts > 1").groupBy("uid").agg(
        F.first("id").alias("id"), F.max("sha").alias("sha"), F.aggregate(parts, empty, add).alias("w")
    )
    return chunks.where("parts = 1").select(*columns, F.col("bytes").alias("n_bytes"), "h0", "h1").unionByName(
        whole.select(*columns, F.col("w.n").alias("n_bytes"), "w.h0", "w.h1")
    )


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
    primes: tuple[int, ...] = PRIMES, places: tuple[int, ...] = PLACES,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are once each run of ASCII white space is one space; a null
    text counts as empty. keep_id is the smallest id of the equal texts (null only if all
    their ids are), group_size their number, and exactly one row of each group is kept: of
    several rows with the smallest id, any one. Extra columns are ignored; an empty table
    gives no rows. text_sha256 is the digest of the normalised text in UTF-8.

    Texts are written once, as chunks of ``chunk`` characters, to the shared folder, so
    that each row has a lasting number and a huge text is split over the tasks that read
    it. Only texts that share a fingerprint are read again. A group of any size is
    summed up before it is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    cut = F.sequence(F.lit(0), F.floor(F.greatest(F.length("norm") - 1, F.lit(0)) / chunk).cast("int"))
    # The chunk number starts at 0 for every text, the empty one too.
    rows = docs.select(F.col(id_col).alias("id"), normal(F.col(text_col)).alias("norm")).withColumn("uid", F.monotonically_increasing_id())
    one = F.length("norm") <= chunk
    pieces = F.when(one, F.array("norm")).otherwise(F.transform(cut, lambda k: F.substring("norm", k * chunk + 1, F.lit(chunk))))
    chunks, place = stored(
        rows.select("id", "uid", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"), pieces.alias("pieces"))
        .select("id", "uid", "sha", F.size("pieces").alias("parts"), F.posexplode("pieces").alias("part", "chunk"))
        .withColumn("sha", F.when(F.col("part") == 0, F.col("sha")))
    )
    facts = composed(durable(hashed(chunks, primes, places)), primes)
    # Classes: texts of one fingerprint, until their chunks say otherwise.
    shared = facts.groupBy(*FINGERPRINT).agg(F.count("*").alias("n"), F.min("uid").alias("class")).where("n > 1")
    shared = durable(shared.select(*FINGERPRINT, "class"))
    again = facts.join(shared, FINGERPRINT).select("uid", "class")
    hit = perhaps(F.xxhash64("uid"), again.select(F.xxhash64("uid").alias("h")))
    members = chunks.where(hit).select("uid", "part", "chunk").join(again, "uid")
    compared = members.groupBy("class", "part").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    unlike = durable(compared.where("least <> most").select("class").distinct())
    classes = facts.join(shared, FINGERPRINT, "left").withColumn("class", F.coalesce("class", "uid"))
    if not unlike.isEmpty():
        suspects = members.join(unlike, "class", "left_semi")
        alike = suspects.groupBy("class", "part", "chunk").agg(F.min("uid").alias("first"))
        signs = suspects.join(alike, ["class", "part", "chunk"]).groupBy("class", "uid").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("part", "first"))), lambda x: x["first"]).alias("sign")
        )
        signs = durable(signs)
        own = signs.join(signs.groupBy("class", "sign").agg(F.min("uid").alias("own")), ["class", "sign"]).select("uid", "own")
        classes = classes.join(own, "uid", "left").withColumn("class", F.coalesce("own", "class")).drop("own")
    classes = durable(classes.select("uid", "id", "sha", "class"))
    discard(spark, place)
    sweep(spark)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("uid"))
    groups = durable(classes.groupBy("class").agg(F.min(order).alias("keep"), F.count("*").alias("group_size")).where("group_size > 1"))
    found = classes.join(groups, "class", "left")
    alone = F.col("group_size").isNull()
    return found.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep.uid"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
