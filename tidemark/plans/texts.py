"""The text path of a run: documents without records become texts, answered texts become insights.

Answers come from outside, so there are two steps. `prepare_texts` stores the text of each document
that the run has rejected; `take_responses` reads what an extraction model answered, checks and scores
it, and stores insights, outputs and states. Texts without an answer yet just wait: the second step may
be repeated with more answers, and replaces what it wrote for the run.

A document whose text cannot be taken, or whose answer is not valid, fails its source and keeps its
reject; one that is answered settles it (`plans/retries.py`). Of several answers to one document the
greatest text counts, so that row order never matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import catalog, insights, quality
from tidemark.operators.joins import join_lookup
from tidemark.operators.ranking import first_per_group
from tidemark.operators.records import extraction
from tidemark.plans import run
from tidemark.sinks.reports import write_run_output
from tidemark.sinks.store import DeltaStore
from tidemark.sources import decode

#: Sorts after what the run and its scan have written.
SUFFIX = "-text"
_DOCUMENT = ["source_queue_id", "doc_id"]
_CONTENT = ["source_queue_id", "content_md5"]
_ERROR_NAME = r"^(\w*(?:Error|Exception|BadZipFile|error)): "


def error_type(error: Column) -> Column:
    """The kind of an error that names it, as decoders do; other ones are errors of a value."""
    named = F.regexp_extract(error, _ERROR_NAME, 1)
    return F.when(error.isNotNull(), F.when(named != "", named).otherwise("ValueError"))


def texts_of(documents: DataFrame, rejects: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Text and notes of every rejected document, or the error.

    `documents` may hold others; only the content of rejected ones is decoded. `max_chars` is a
    limit of the model: a text that is cut says so in its notes, which lowers its score.
    """
    wanted = join_lookup(documents, rejects.select(*_DOCUMENT).distinct(), _DOCUMENT, "left_semi")
    texts = decode.document_text(wanted)
    if max_chars is not None:
        texts = decode.limit_text(texts, max_chars)
    known = rejects.select(
        *_DOCUMENT, "path", "observed_at", "content_md5", "byte_count", F.col("notes").alias("table_notes")
    )
    nothing = F.array().cast("array<string>")
    # Narrow facts meet the texts; the tables' notes come first.
    return join_lookup(texts, known, _DOCUMENT, "inner").select(
        *_DOCUMENT,
        "path",
        "observed_at",
        "content_md5",
        "byte_count",
        "route",
        "text",
        F.concat(F.coalesce("table_notes", nothing), F.coalesce("notes", nothing)).alias("notes"),
        "error",
    )


def extractions_of(texts: DataFrame, responses: DataFrame) -> DataFrame:
    """Checked and scored answers of the texts that have one, and the texts that failed.

    `responses` has source_queue_id, content_md5 and response. Rows with an error have no fields,
    confidence or review status.
    """
    facts = texts.drop("text", "route").withColumnRenamed("error", "text_error")
    answers = responses.groupBy(*_CONTENT).agg(F.max("response").alias("response"))
    met = facts.join(answers, _CONTENT, "left").filter("text_error is not null or response is not null")
    checked = quality.validate_extractions(met)
    why = F.coalesce("text_error", "error")
    scored = quality.score_extractions(checked.withColumn("error", why))
    given = ["extraction_confidence", "review_status", "review_reasons"]
    fields = ["interconnection_queue_id", "capacity_mw", "substation_or_node", "status", "developer_name"]
    good = F.col("error").isNull()
    return scored.select(
        *[c for c in facts.columns if c != "text_error"],
        *[F.when(good, F.col(c)).alias(c) for c in (*fields, *given)],
        "error",
        error_type(F.col("error")).alias("error_type"),
    )


def prepare_texts(
    store: DeltaStore, documents: DataFrame, run_id: str, max_chars: int | None = None
) -> DataFrame:
    """Store the texts of the documents a run has rejected; gives those to be answered."""
    rejects = store.of_run("rejects", run_id)
    store.write("texts", texts_of(documents, rejects, max_chars), run_id)
    return store.of_run("texts", run_id).filter("error is null")


def take_responses(
    store: DeltaStore, responses: DataFrame, run_id: str, model_id: str, parsed_at: Column
) -> DataFrame:
    """Store extractions, insights, outputs and states of the answers; gives the extractions."""
    store.write("extractions", extractions_of(store.of_run("texts", run_id), responses), run_id)
    done = store.of_run("extractions", run_id)
    good = done.filter("error is null")
    output = f"{store.root}/outputs/{run_id}{SUFFIX}"
    state = catalog.latest_by_source(
        store.read("state").filter(F.col("snapshot_id") < run_id + SUFFIX), "snapshot_id"
    ).drop("snapshot_id")
    pending = F.coalesce(F.nullif("pending_fingerprint", F.lit("")), "last_remote_fingerprint")
    met = state.select("source_queue_id", pending.alias("remote_fingerprint"))
    evidence = run.evidence_of(good, run.catalog_metadata(store), met, output)
    found = insights.extraction_insights(evidence, model_id, parsed_at)
    store.write("insights", found.withColumn("source_queue_id", F.col("queue_id")), run_id + SUFFIX)
    said = evidence.select(
        F.col("source_queue_id").alias("queue_id"), "observed_at", "source_url", "raw_s3_bucket", "raw_s3_key",
        "content_md5", "remote_fingerprint", F.lit(model_id).alias("model_id"), F.col("notes").alias("extraction_notes"),
        "extraction_confidence", "review_status", "review_reasons", extraction().alias("extraction"),
        parsed_at.alias("parsed_at"),
    )
    write_run_output(said, output)
    store.write("state", text_state(state, done, met), run_id + SUFFIX)
    return done


def text_state(state: DataFrame, done: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """State of the sources whose texts were answered or failed; of several documents of a source the
    newest counts. Only a success settles the fingerprint that the scan has met."""
    newest = first_per_group(done, ["source_queue_id"], F.struct("observed_at", "path", "content_md5"))
    good = newest.filter("error is null").join(fingerprints, "source_queue_id", "left")
    settled = good.select(
        "source_queue_id",
        F.lit("SUCCEEDED").alias("parser_status"),
        F.col("observed_at").alias("last_changed_at"),
        F.col("observed_at").alias("last_parsed_at"),
        F.col("content_md5").alias("last_content_md5"),
        F.col("path").alias("last_raw_key"),
        F.col("byte_count").alias("last_bytes"),
        F.col("remote_fingerprint").alias("last_remote_fingerprint"),
        F.lit("").alias("pending_fingerprint"),
        F.col("extraction_confidence").alias("last_extraction_confidence"),
        F.col("review_status").alias("last_review_status"),
        F.lit("").alias("last_error"),
        F.lit("").alias("last_error_type"),
    )
    failed = run.failure_update(newest.filter("error is not null"))
    updates = settled.unionByName(failed, allowMissingColumns=True)
    old = state.join(updates.select("source_queue_id"), "source_queue_id", "left_semi")
    return catalog.upsert_state(old, updates)
