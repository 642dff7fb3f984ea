"""A backlog of versions gives what single runs give."""

import hashlib
import random

from pyspark.sql import functions as F

from tests.test_pipeline import at, csv_body
from tidemark.plans import run
from tidemark.plans.backlog import ingest_backlog
from tidemark.sinks.store import DeltaStore

DOCUMENTS = "source_queue_id string, doc_id string, path string, content_type string, modificationTime timestamp, content binary"


def bodies(seed, versions):
    """Bodies of one source: rows come, go and change; some versions repeat, some are no tables."""
    rng = random.Random(seed)
    rows, out = {i: (i * 10, "Active") for i in range(1, 9)}, []
    for _ in range(versions):
        kind = rng.random()
        if kind < 0.2 and out:
            out.append(out[-1])
        elif kind < 0.4:
            out.append(rng.choice(["", "no table here\n", "Queue Number,Status\n"]))
        elif kind < 0.5 and len(out) > 2:
            out.append(out[-2])
        else:
            for i in rng.sample(range(1, 12), 3):
                if i in rows and rng.random() < 0.5:
                    del rows[i]
                else:
                    rows[i] = (rng.randrange(1, 90), rng.choice(["Active", "Withdrawn"]))
            out.append(csv_body([(i, *v) for i, v in sorted(rows.items())]))
    return out


def frame(spark, rows):
    rows = [(s, p, p, None, when, bytearray(body.encode())) for s, p, when, body in rows]
    return spark.createDataFrame(rows, DOCUMENTS.replace("timestamp", "string")).withColumn(
        "modificationTime", F.col("modificationTime").cast("timestamp")
    )


def landed(sources, low, high):
    return [
        (name, f"raw/{name}/{n:03d}.csv", f"2026-05-{n + 1:02d} 09:00:00", texts[n])
        for name, texts in sources.items()
        for n in range(low, min(high, len(texts)))
    ]


def content(store, table, *dropped):
    rows = store.read(table).drop("snapshot_id", "output_s3_key", *dropped)
    if "source_row" in rows.columns:
        rows = rows.withColumn("source_row", F.sort_array(F.map_entries("source_row")))
    return sorted(str(r) for r in rows.collect())


def test_backlog_equals_single_runs(spark, tmp_path):
    sources = {"east": bodies(1, 5), "west": bodies(2, 3), "north": ["nothing\n", "nothing else\n"]}
    one = DeltaStore(spark, str(tmp_path / "one"))
    whole = DeltaStore(spark, str(tmp_path / "whole"))
    number = 0
    for low, high in ((0, 2), (2, 5)):
        ingest_backlog(whole, frame(spark, landed(sources, low, high)), f"{low:04d}", F.col("modificationTime"))
        for n in range(low, high):
            rows = landed(sources, n, n + 1)
            known = {r.source_queue_id: r.content_md5 for r in one.read("manifest").orderBy("snapshot_id").collect()}
            rows = [r for r in rows if hashlib.md5(r[3].encode()).hexdigest() != known.get(r[0])]
            if rows:
                run.ingest(one, frame(spark, rows), f"{number:04d}", F.col("modificationTime"))
            number += 1
    for table in ("deltas", "insights", "manifest"):
        mine, theirs = content(whole, table, "parsed_at"), content(one, table, "parsed_at")
        assert mine == theirs, (table, len(mine), len(theirs), sorted(set(mine) ^ set(theirs))[:4])
    shown = ["source_queue_id", "parser_status", "last_content_md5", "last_record_count", "last_delta_count", "last_error", "last_raw_key"]
    states = [sorted(str(r) for r in s.latest_rows("state").select(*shown).collect()) for s in (whole, one)]
    assert states[0] == states[1]
    # A repeated backlog gives the same tables, an old one that has not changed gives nothing.
    before = content(whole, "deltas")
    ingest_backlog(whole, frame(spark, landed(sources, 2, 5)), "0002", F.col("modificationTime"))
    assert content(whole, "deltas") == before
    last = {name: [texts[-1]] for name, texts in sources.items() if name == "west"}
    if whole.latest_rows("state").filter("source_queue_id = 'west' and parser_status = 'SUCCEEDED'").count():
        assert ingest_backlog(whole, frame(spark, landed(last, 0, 1)), "0009", at("2026-06-01 00:00:00")) is None


def test_many_versions_are_one_chain(spark, tmp_path):
    """Sixty versions of one source: one new project each, one removed every tenth time."""
    texts, rows = [], {}
    for n in range(60):
        rows[n] = (n + 1, "Active")
        if n % 10 == 9:
            del rows[n - 5]
        texts.append(csv_body([(i, *v) for i, v in sorted(rows.items())]))
    documents = [("east", f"raw/east/{n:04d}.csv", "2026-05-01 09:00:00", body) for n, body in enumerate(texts)]
    store = DeltaStore(spark, str(tmp_path))
    done = ingest_backlog(store, frame(spark, documents).repartition(4), "0001", F.col("modificationTime"))
    assert done.count() == 60
    got = {r.delta_type: r["count"] for r in store.read("deltas").groupBy("delta_type").count().collect()}
    assert got == {"BASELINE": 1, "NEW": 59, "REMOVED": 6}
