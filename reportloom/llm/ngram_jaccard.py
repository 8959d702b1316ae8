"""N-gram Jaccard join by vertical partitioning.

Every text becomes its set of hashed word shingles. One global order of shingles
puts widespread ones last and is cut into fragments. The head of a set is so long
that two linked sets share a known number of shingles of their heads. Each fragment
sees only its own part of each head and counts what meets there; the partial counts
of all fragments are summed per set, and a set whose sum cannot reach that number
links with nothing. Of the others, a set is paired with the smallest set that holds
one of its shingles, the partial overlaps are summed per pair, and the best pair of
each set is verified on whole sets.

What these pairs leave in different components goes through the fragments once more,
now with whole sets: a set links across components only if enough of its shingles lie
in other components, in sets of a fitting size. The few that pass are dealt into
bounded blocks, and blocks that share a shingle count the overlaps of their sets,
again as sums over fragments of the order. No pair is written but those that link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportloom.llm.common import FILTER_BITS, components, discard, durable, partitions, ship, stored, sweep, table

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Shingles of one fragment, about; their number follows the input.
FRAGMENT = 1_000_000
#: A head is longer than needed by this part of its set, so that linked sets share as many more.
SPARE = 20
#: Most widespread shingles that go last in the global order (8 bytes each).
WIDESPREAD = 1 << 18


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles (fewer words: one shingle)."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    size = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    flat = words.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    text_of = np.repeat(np.arange(len(size)), size)[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    names = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    h = names[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.uint64)
    n = np.bincount(text_of, minlength=len(size))
    first = np.cumsum(n) - n
    rolled = np.zeros(len(h), dtype=np.uint64)
    for j in range(k):  # h[i] * m^(k-1) + ... + h[i+k-1]
        rolled *= _MIX
        if j < len(h):
            rolled[: len(h) - j] += h[j:]
    rolled = _mixed(rolled)
    sets = []
    for a, m in zip(first.tolist(), n.tolist(), strict=True):
        if m >= k:
            x = np.sort(rolled[a : a + m - k + 1])
            sets.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif m:
            x = np.uint64(m)
            for w in h[a : a + m]:
                x = x * _MIX + w
            sets.append(_mixed(np.array([x], dtype=np.uint64)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _batches(batches, k):
    """(batch, sets) in slices that keep the working set small."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + 8_000_000, side="right")))
            part = batch.slice(start, stop - start)
            with np.errstate(over="ignore"):
                yield part, shingle_sets(part.column("text"), k)
            start = stop


def ngram_jaccard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 75,
    rounds: int = 2,
    block: int = 256,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    A-Z is lower-cased and words are runs of anything but ASCII white space. Two
    texts link when 100 * intersection >= ``percent`` * union of their shingle
    sets; a text without words links with nothing; one with fewer words than a
    shingle is one shingle. component_id is the smallest id reachable by links,
    itself included. A null text has no words. Rows with a null id get their
    count and a null component and link with nothing. Rows of one id are one
    node: any of their links count. Extra columns are ignored; an empty table
    gives no rows. Texts are read whole.

    Shingles and sets are told apart by 64-bit hashes. The driver sees counts
    and at most ``WIDESPREAD`` shingles, which only say what stands last in the
    order. ``rounds`` is how often a set tries its best pair before the blocks,
    of at most ``block`` sets each, settle what is left.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = rows.where("id IS NOT NULL")
    id_type = rows.schema["id"].dataType.simpleString()
    enough = lambda n: -(-percent * n // 100)  # noqa: E731  shingles that any link shares, at least

    def describe(batches):
        """(id, size, set) of each row and, with a count, shingles that several texts of this task hold."""
        seen, held, names = set(), [], ["id", "n", "node", "token", "count"]

        def counted(ids):
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= 2
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(none), ids), none, none, pa.array(token[often].view(np.int64)), pa.array(count[often])], names)

        kind = None
        for batch, sets in _batches(batches, words):
            kind = batch.schema.field("id").type
            node = [digest(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(len, sets), pa.int64()), pa.array(node, pa.int64()), none, none], names)
            for d, s in zip(node, sets, strict=True):
                if len(s) and d not in seen:
                    seen.add(d)
                    held.append(s)
            if sum(map(len, held)) > 4_000_000:
                yield counted(kind)
                held, seen = [], set()
        if held:
            yield counted(kind)

    first_pass = durable(rows.mapInArrow(describe, f"id {id_type}, n long, node long, token long, count long"))
    described = first_pass.where("node IS NOT NULL").select("id", "n", "node")
    nodes = described.where("n > 0 AND id IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.min("id").alias("id"))
    often = (
        first_pass.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count"))
        .where("count >= 6").orderBy(F.desc("count"), "token").limit(WIDESPREAD)
    )
    last = np.sort(often.select("token").toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))
    total = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fragments = max(partitions(spark), total // (2 * FRAGMENT))

    def cut(token: np.ndarray, fragments: int) -> np.ndarray:
        """The fragment of the order that a shingle falls into."""
        return ((token >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)

    def widespread(s: np.ndarray) -> np.ndarray:
        return last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s if len(last) else np.zeros(len(s), dtype=bool)

    def heads(batches):
        """(fragment, shingle, set, widespread?) of each head; equal sets once per task.

        Rows of a widespread shingle need not meet to know that it is shared, so they
        are dealt by their sets.
        """
        seen: set[int] = set()
        for _, sets in _batches(batches, words):
            out = []
            for s in sets:
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                late = widespread(s)
                size = min(len(s), len(s) - enough(len(s)) + 1 + len(s) // SPARE)
                token = np.concatenate([s[~late], s[late]])[:size]
                common = np.arange(size) >= len(s) - late.sum()
                out.append((np.where(common, d % fragments, cut(token, fragments)), token.view(np.int64), np.full(size, d, dtype=np.int64), common))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["fragment", "token", "node", "common"])

    def meet(batches):
        """Of a fragment, the rows of shingles that two or more sets hold."""
        got = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "node", "common")) for b in batches if b.num_rows]
        if not got:
            return
        token, node, common = (np.concatenate(x) for x in zip(*got, strict=True))
        by = np.lexsort((node, token))
        token, node, common = token[by], node[by], common[by]
        once = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
        token, node, common = token[once], node[once], common[once]
        group = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
        met = np.flatnonzero(common | (np.bincount(group)[group] > 1))
        for a in range(0, len(met), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(token[met[a : a + 100_000]]), pa.array(node[met[a : a + 100_000]])], ["token", "node"])

    dealt = texts.mapInArrow(heads, "fragment long, token long, node long, common boolean").repartition(fragments, "fragment")
    met = durable(dealt.mapInArrow(meet, "token long, node long"))
    least = lambda n: 1 + F.floor(n / SPARE)  # noqa: E731  shared head shingles of linked sets, by the smaller one's size
    smallest = F.ceil(F.col("n") * percent / 100)  # that a partner may be
    alive = durable(met.groupBy("node").agg(F.count("*").alias("c")).join(nodes, "node").where(F.col("c") >= least(smallest)).select("node", "n", "id"))
    met = durable(met.join(alive.select("node", "n"), "node"))
    sweep(spark)

    def marked(df: DataFrame, column: str):
        """A broadcast bit for each value of a long column, in a filter of fixed size."""
        bits = df.groupBy(F.shiftright(F.pmod(column, F.lit(FILTER_BITS)), 6).alias("word")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({column}, {FILTER_BITS}) % 64 AS int))")).alias("bits")
        ).toPandas()
        marks = np.zeros(FILTER_BITS // 64, dtype=np.int64)
        marks[bits["word"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64)
        return spark.sparkContext.broadcast(marks.tobytes())

    wanted = marked(alive.select(F.xxhash64("id").alias("h")), "h")

    def whole(batches):
        """(set, its shingles) of the rows whose id may be wanted."""
        flags = np.frombuffer(wanted.value, dtype=np.uint64)

        def some():
            for batch in batches:
                v = batch.column("h").to_numpy().view(np.int64) % FILTER_BITS
                yield batch.filter(pa.array((flags[v >> 6] >> (v & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

        for _, sets in _batches(some(), words):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "held"])

    held = (
        texts.select(F.xxhash64("id").alias("h"), "text").mapInArrow(whole, "node long, held binary")
        .join(alive.select("node"), "node", "left_semi").groupBy("node").agg(F.first("held").alias("held"))
    )
    held, held_at = stored(held)
    sweep(spark)

    def fitting(a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"

    def best(linked: DataFrame) -> DataFrame:
        """Each set's best pair (a, b) with a set of another component that leads one of its shingles."""
        placed = met.join(linked, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        lead = placed.groupBy("token").agg(F.min(F.struct("n", "node", "comp")).alias("lead"))
        pairs = (
            placed.join(lead, "token").where("comp <> lead.comp").where(fitting("n", "lead.n"))
            .groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("na"), F.first("lead.n").alias("nb"))
            .where(F.col("c") >= least(F.least("na", "nb")))
        )
        return pairs.groupBy("a").agg(F.min(F.struct(-F.col("c"), "nb", "b", "na")).alias("p")).select("a", "p.b", "p.na", "p.nb")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = pairs.join(held.select(F.col("node").alias("b"), F.col("held").alias("y")), "b")
        both = pairs.join(held.select(F.col("node").alias("a"), F.col("held").alias("x")), "a")

        def overlap(batches):
            for batch in batches:
                a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
                x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
                count = [len(np.intersect1d(np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8"), assume_unique=True)) for p, q in zip(x, y, strict=True)]
                count = np.array(count, dtype=np.int64)
                fits = 100 * count >= percent * (na + nb - count)
                yield pa.RecordBatch.from_arrays([pa.array(a[fits]), pa.array(b[fits])], ["a", "b"])

        return both.select("a", "b", "na", "nb", "x", "y").mapInArrow(overlap, "a long, b long")

    links = spark.createDataFrame([], "a long, b long")

    def grown(more: DataFrame) -> DataFrame:
        nonlocal links
        links = durable(links.unionByName(more))
        return components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    linked = spark.createDataFrame([], "node long, component long")
    for _ in range(rounds):
        linked = grown(verified(durable(best(linked))))
        sweep(spark)

    # Sets with enough head shingles in other components, with their whole sets.
    placed = durable(met.join(linked, "node", "left").withColumn("comp", F.coalesce("component", "node")).select("token", "node", "n", "comp"))
    apart = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    left = durable(
        placed.join(apart, "token").groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("comp").alias("comp"))
        .where(F.col("c") >= least(smallest)).select("node", "n", "comp")
    )

    fewer = max(partitions(spark), left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // FRAGMENT)

    def spread(batches):
        """(fragment, shingle, set, size, component) of whole sets."""
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in ("held", "node", "n", "comp")), strict=True):
                token = np.frombuffer(s, "<u8")
                for a in range(0, len(token), 100_000):
                    part = token[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cut(part, fewer)), pa.array(part.view(np.int64)), *(pa.array(np.full(len(part), v, dtype=np.int64)) for v in row)],
                        ["fragment", "token", "node", "n", "comp"],
                    )

    def elsewhere(batches):
        """Of a fragment: for each set and size, how many of its shingles lie in other components, in sets of at least that size.

        Sizes below a fitting partner's count as the least of these and others are
        rounded down in steps of an eighth of the set; shingles in larger sets alone
        don't count.
        """
        got = [tuple(b.column(c).to_numpy() for c in ("token", "node", "n", "comp")) for b in batches if b.num_rows]
        if not got:
            return
        token, node, n, comp = (np.concatenate(x) for x in zip(*got, strict=True))
        by = np.lexsort((n, token))
        token, node, n, comp = token[by], node[by], n[by], comp[by]
        opens = np.r_[True, token[1:] != token[:-1]]
        group, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
        foreign = comp != comp[first][group]
        second = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(second, group[foreign], n[foreign])
        size = np.where(foreign, n[first][group], second[group])
        k = 100 * n >= percent * np.minimum(size, 1 << 56)
        node, n, size = node[k], n[k], size[k]
        low = enough(n)
        size = low + np.maximum(0, size - low) * 8 // n * n // 8
        counted = pd.DataFrame({"node": node, "size": size}).value_counts()
        for a in range(0, len(counted), 100_000):
            part = counted.iloc[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([*(pa.array(part.index.get_level_values(c).to_numpy(np.int64)) for c in ("node", "size")), pa.array(part.to_numpy(np.int64))], ["node", "size", "c"])

    exploded = "fragment long, token long, node long, n long, comp long"
    counts = (left.join(held, "node").mapInArrow(spread, exploded).repartition(fewer, "fragment").mapInArrow(elsewhere, "node long, size long, c long"))
    # An overlap is at most the shingles found elsewhere, so a partner is at most this large.
    most = F.floor(F.col("all") * (100 + percent) / percent) - F.col("n")
    counts = durable(counts.groupBy("node", "size").agg(F.sum("c").alias("c")))
    sweep(spark)
    room = counts.groupBy("node").agg(F.sum("c").alias("all")).join(left, "node").withColumn("most", most)
    last_ones = durable(
        counts.join(room, "node").where("size <= most").groupBy("node").agg(F.sum("c").alias("c"), F.first("n").alias("n"), F.first("comp").alias("comp"))
        .where(F.col("c") >= F.ceil(F.col("n") * percent / 100)).select("node", "n", "comp")
    )

    # Their shingles, rare ones first; as long a head of these as two linked sets must share one of.
    tokens = durable(last_ones.join(held, "node").mapInArrow(spread, exploded).select("token", "node", "n", "comp"))
    known = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token", "df")
    tokens = durable(tokens.join(known, "token"))
    key = tokens.groupBy("node").agg(F.max(F.struct("df", "token")).alias("top"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("comp").alias("comp"))
    key = key.where(F.col("c") >= F.ceil(F.col("n") * percent / 100)).select("node", "n", "comp", "c", F.col("top.token").alias("key"))
    crowd = key.groupBy("comp").agg((F.count("*") > block // 2).alias("alone"))
    key = durable(key.join(crowd, "comp").withColumn("crew", F.xxhash64("key", "alone", F.when(F.col("alone"), F.col("comp")))))
    sizes = key.groupBy("crew").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / FRAGMENT)).alias("parts"))
    blocks = durable(
        key.join(sizes, "crew").select(
            "node", "n", "comp", "c", F.when(F.col("alone"), F.col("comp")).alias("alone"),
            F.xxhash64("crew", F.pmod(F.xxhash64("node"), "parts")).alias("block"),
        )
    )
    rare_first = Window.partitionBy("node").orderBy("df", "token")
    short = (
        tokens.select("token", "df", "node").join(blocks.select("node", "n", "c", "alone", "block"), "node")
        .withColumn("place", F.row_number().over(rare_first)).where(F.col("place") <= F.col("c") - F.ceil(F.col("n") * percent / 100) + 1)
        .select("token", "block", "alone").distinct()
    )
    short = durable(short)
    facing = short.alias("p").join(short.alias("q"), "token").where("p.block <= q.block AND (p.alone IS NULL OR q.alone IS NULL OR p.alone <> q.alone)")
    facing = durable(facing.select(F.col("p.block").alias("p"), F.col("q.block").alias("q")).distinct())
    sides = facing.select("p", "q", F.explode(F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q"))).alias("block"))
    stocked = sides.join(blocks.join(held, "node").select("block", "node", "n", "comp", "held"), "block")

    def compare(pair: pa.Table) -> pa.Table:
        """Links between the sets of two blocks that connect all components which any link of theirs connects."""
        node, n, comp, block_of = (pair.column(c).to_numpy() for c in ("node", "n", "comp", "block"))
        sets = [np.frombuffer(x, "<u8") for x in pair.column("held").to_pylist()]
        one = np.flatnonzero(block_of == block_of.min())
        two = one if block_of.min() == block_of.max() else np.flatnonzero(block_of == block_of.max())
        both = np.intersect1d(*(np.unique(np.concatenate([sets[k] for k in side])) for side in (one, two)))
        shared = np.zeros((len(one), len(two)), dtype=np.int64)
        for a in range(0, len(both), 4096):
            part = both[a : a + 4096]

            def matrix(side, part=part):
                out = np.zeros((len(side), len(part)), dtype=np.float32)
                for r, k in enumerate(side):
                    s = sets[k][np.searchsorted(sets[k], part[0]) : np.searchsorted(sets[k], part[-1], side="right")]
                    at = np.minimum(np.searchsorted(part, s), len(part) - 1)
                    out[r, at[part[at] == s]] = 1
                return out

            x = matrix(one)
            shared += (x @ (x if two is one else matrix(two)).T).astype(np.int64)
        links = 100 * shared >= percent * (n[one][:, None] + n[two][None, :] - shared)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        needed = []
        for r, c in zip(*(x.tolist() for x in np.nonzero(links & (comp[one][:, None] != comp[two][None, :]))), strict=True):
            x, y = root(int(comp[one[r]])), root(int(comp[two[c]]))
            if x != y:
                up[max(x, y)] = min(x, y)
                needed.append((node[one[r]], node[two[c]]))
        return pa.table({"a": pa.array([a for a, _ in needed], pa.int64()), "b": pa.array([b for _, b in needed], pa.int64())})

    linked = grown(stocked.groupBy("p", "q").applyInArrow(compare, "a long, b long"))
    discard(spark, held_at)
    sweep(spark)

    placed = described.join(linked, "node", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("comp"))
    per_set = placed.where("comp IS NOT NULL AND id IS NOT NULL").groupBy("comp").agg(F.min("id").alias("low"))
    return placed.join(per_set, "comp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))
