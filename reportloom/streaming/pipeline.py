"""The document queue as a file stream: each arriving envelope is analysed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reportloom.operators import document_job
from reportloom.operators.document_job import Job
from reportloom.sources import sinks

#: What arrives: an envelope, with what is known about its document.
ENVELOPES = "doc_id STRING, raw_json STRING, " + ", ".join(f"{c} STRING" for c in sinks.ABOUT)
#: What a finished document's status row holds of its rows.
FIGURES = ["is_cumulative", "line_count", "customer_count", "total_net_sales", "total_commission", "detected"]
#: The states a document passes, with its progress on entering each.
STATES = {"Queued": 0.0, "Extracting": 10.0, "Mapping": 60.0, "Done": 100.0, "Failed": 100.0, "Cancelled": 100.0}
#: Where a document may go from each state; an analysis may begin anew from any end, and from where one broke off.
NEXT = {"Queued": ["Extracting", "Failed", "Cancelled"], "Extracting": ["Mapping", "Failed", "Cancelled", "Queued"], "Mapping": ["Done", "Failed", "Cancelled", "Queued"],
        "Done": ["Queued"], "Failed": ["Queued"], "Cancelled": ["Queued"]}


def job(raw: DataFrame) -> Job:
    """Envelopes analysed by their documents' own instructions; what isn't known about a document counts as null."""
    known = raw.select("doc_id", "raw_json", *(F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in sinks.ABOUT))
    done = document_job.run(known)
    return Job(done.sales.withColumn("content_no", F.floor(F.col("row_no") / document_job.SHEET).cast("int")), done.documents)


def analyse(raw: DataFrame) -> DataFrame:
    """Envelopes to canonical rows; each sheet's blocks stay apart, ids are left as they are."""
    return job(raw).sales


def states(ids: DataFrame, state: str, error: str | None = None) -> DataFrame:
    """Status rows: doc_id, status, progress_pct, error_message."""
    return ids.select(
        "doc_id", F.lit(state).alias("status"), F.lit(STATES[state]).alias("progress_pct"), F.lit(error).cast("string").alias("error_message")
    )


def allowed(was: str, now: str) -> bool:
    return was == now or now in NEXT.get(was, [])


def advance(target: str, ids: DataFrame, state: str) -> None:
    """Moves those of the documents to ``state`` that may go there from where they are; an unknown one may be Queued.

    A store keeps its earlier states, so a document's way can be read back until it is compacted.
    """
    ids = ids.select("doc_id").distinct()
    held = sinks.read(ids.sparkSession, f"{target}/status")
    if held is None:
        may = ids if state == "Queued" else ids.where("false")
    else:
        before = [was for was in NEXT if allowed(was, state)]
        known = ids.join(held.select("doc_id", F.col("status").alias("_was")), "doc_id", "left")
        may = known.where(F.col("_was").isin(before) | (F.col("_was").isNull() & F.lit(state == "Queued"))).select("doc_id")
    sinks.replace_documents(states(may, state), f"{target}/status")


def newest_of(queued: DataFrame) -> DataFrame:
    """One envelope of each document: the one that arrived last, by file time, then by its text."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("arrived"), F.desc("raw_json"))
    return queued.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def tag(document: str) -> str:
    return f"document-{document}"


def process(raw: DataFrame, target: str, work: Callable[[DataFrame], DataFrame | Job] = job) -> None:
    """Analyses documents and stores rows and statuses; one that fails leaves the others alone.

    A document that :func:`job` can't analyse is a row that says so, among the others. Only
    where the work itself raises are documents done in halves, down to the one that fails, which is marked Failed with its reason and keeps
    its earlier rows. A single document's jobs carry its tag (see :func:`cancel`).
    """
    spark = raw.sparkSession
    context = spark.sparkContext
    documents = raw.select("doc_id").distinct()
    try:
        result = work(raw)
        if isinstance(result, Job):
            failed = result.documents.where("status = 'Failed'").select("doc_id")
            sinks.write_sales(result.sales, f"{target}/sales", documents.join(failed, "doc_id", "left_anti"))
            status = result.documents.select("doc_id", "status", F.lit(STATES["Done"]).alias("progress_pct"), "error_message", *FIGURES)
        else:
            sinks.write_sales(result, f"{target}/sales", documents)
            status = states(documents, "Done")
        sinks.replace_documents(status, f"{target}/status")
        return
    except Exception as error:
        reason = str(error)[:500]
    found = [r.doc_id for r in documents.orderBy("doc_id").limit(2).collect()]
    if len(found) < 2:
        cancelled = "cancelled" in reason.lower() and "tag" in reason.lower()
        sinks.replace_documents(states(documents, "Cancelled" if cancelled else "Failed", reason), f"{target}/status")
        return
    middle = documents.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY xxhash64(doc_id))").alias("m")).first().m
    low = F.xxhash64("doc_id") <= middle
    halves = [raw.where(low), raw.where(~low)]
    if any(h.isEmpty() for h in halves):  # only by equal hashes
        halves = [raw.where(F.col("doc_id") == found[0]), raw.where(F.col("doc_id") != found[0])]
    for half in halves:
        few = [r.doc_id for r in half.select("doc_id").distinct().limit(2).collect()]
        if len(few) == 1:
            context.addJobTag(tag(few[0]))
        try:
            process(half, target, work)
        finally:
            if len(few) == 1:
                context.removeJobTag(tag(few[0]))


def start(
    spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 10,
    work: Callable[[DataFrame], DataFrame | Job] = job,
) -> StreamingQuery:
    """Analyses what has arrived and stops; started again, goes on where it was.

    A document that is queued twice in a batch is analysed once, as it came last, and
    a document that comes again replaces its earlier rows, so a restart repeats
    nothing. Envelopes are kept as they came in ``target``/raw.
    """
    def batch(frame: DataFrame, number: int) -> None:
        newest = newest_of(frame).drop("arrived").persist()
        try:
            advance(target, newest, "Queued")
            advance(target, newest, "Extracting")
            sinks.write_raw(newest, f"{target}/raw")
            advance(target, newest, "Mapping")
            process(newest, target, work)
        finally:
            newest.unpersist()

    stream = spark.readStream.schema(ENVELOPES).option("maxFilesPerTrigger", files_per_batch).json(source)
    stream = stream.withColumn("arrived", F.col("_metadata.file_modification_time"))
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reanalyse(spark: SparkSession, target: str, ids: DataFrame, work: Callable[[DataFrame], DataFrame | Job] = job) -> None:
    """Canonical rows and statuses of these documents anew from the raw envelopes, which stay.

    Where ``ids`` has custom_instructions, these replace the documents' own, in the raw store
    too (null: none). Statuses begin anew at Queued, without figures; documents of which
    no envelope is held are left out.
    """
    raw = sinks.read(spark, f"{target}/raw")
    if raw is None:
        return
    told = "custom_instructions" in ids.columns
    if told:
        new = ids.groupBy("doc_id").agg(F.first("custom_instructions").alias("_told"))
        raw = raw.drop("custom_instructions").join(new, "doc_id").withColumnRenamed("_told", "custom_instructions")
    else:
        raw = raw.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    raw = raw.drop("extracted_ts").persist()
    try:
        if told:
            sinks.write_raw(raw, f"{target}/raw")
        for state in ("Queued", "Extracting", "Mapping"):  # nothing is extracted again, but no state is left out
            advance(target, raw, state)
        process(raw, target, work)
    finally:
        raw.unpersist()


def delete(target: str, ids: DataFrame) -> None:
    """Everything held of these documents."""
    sinks.delete_documents(ids, f"{target}/raw", f"{target}/sales", f"{target}/status")


def cancel(spark: SparkSession, document: str) -> None:
    """Cancels the jobs of a document that is analysed on its own; it ends as Cancelled."""
    spark.sparkContext.cancelJobsWithTag(tag(document))


def backfill(documents: DataFrame, sales: DataFrame) -> DataFrame:
    """Aggregates of finished documents that lack them, all in one aggregation."""
    from reportloom.operators.analytics import document_aggregates

    missing = documents.where("status = 'Done' AND line_count IS NULL").select(F.col("id").alias("doc_id"))
    return document_aggregates(sales.join(missing, "doc_id", "left_semi"), "doc_id")
