"""Snapshot comparison: invariants, ranking and the paths for large groups."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains, delta, insights
from tidemark.operators.joins import join_lookup
from tidemark.operators.ranking import top_per_group
from tidemark.vocabulary import TRACKED_FIELDS



def snapshot(spark, rows):
    """Records of (source, key, capacity, status) rows."""
    data = [
        (source, key, i, key, None, capacity, status, f"{capacity}/{status}", i)
        for i, (source, key, capacity, status) in enumerate(rows)
    ]
    schema = (
        "source_queue_id string, project_key string, ord bigint, interconnection_queue_id string, "
        "project_name string, capacity_mw bigint, status string, record_fingerprint string, "
        "first_seen bigint"
    )
    frame = spark.createDataFrame(data, schema)
    empty = {c: F.lit(None).cast("string") for c in TRACKED_FIELDS.values() if c not in frame.columns}
    return frame.withColumns(empty)


def manifest(spark, *sources):
    return spark.createDataFrame([(s,) for s in sources], "source_queue_id string")


def random_rows(seed, changed=0.3):
    rng = random.Random(seed)
    rows = {}
    for source in ("a", "b"):
        for i in range(40):
            if rng.random() < 0.8:
                rows[source, f"k{i}"] = (rng.choice([5, 5, 5, 9]), rng.choice(["Active", "Active", "Done"]))
    return [(s, k, *v) for (s, k), v in rows.items()]


@pytest.mark.parametrize("seed", range(3))
def test_diff_invariants(spark, seed):
    old_rows, new_rows = random_rows(seed), random_rows(seed + 100)
    old, new = snapshot(spark, old_rows), snapshot(spark, new_rows)
    rows = delta.diff_snapshots(new, old).collect()
    by_kind = {k: [r for r in rows if r.delta_type == k] for k in ("NEW", "UPDATED", "REMOVED")}
    before = {(s, k): v for s, k, *v in old_rows}
    after = {(s, k): v for s, k, *v in new_rows}
    keys = lambda kind: {(r.source_queue_id, r.project_key) for r in by_kind[kind]}
    assert keys("NEW") == after.keys() - before.keys()
    assert keys("REMOVED") == before.keys() - after.keys()
    assert keys("UPDATED") == {k for k in before.keys() & after.keys() if before[k] != after[k]}
    assert all(r.status == "Withdrawn" and r.changed_fields == ["Status"] for r in by_kind["REMOVED"])
    assert all(r.changed_fields for r in by_kind["UPDATED"])
    assert all(not r.changed_fields for r in by_kind["NEW"])
    # Applying the deltas to the previous snapshot gives the current one.
    applied = {k: v for k, v in before.items() if k not in keys("REMOVED")}
    for r in by_kind["NEW"] + by_kind["UPDATED"]:
        applied[r.source_queue_id, r.project_key] = [r.capacity_mw, r.status]
    assert applied == after
    # Swapped snapshots swap new and removed.
    back = delta.diff_snapshots(old, new).groupBy("delta_type").count().collect()
    counts = {r.delta_type: r["count"] for r in back}
    assert counts.get("NEW", 0) == len(by_kind["REMOVED"])
    assert counts.get("REMOVED", 0) == len(by_kind["NEW"])
    assert delta.diff_snapshots(new, new).isEmpty()


def test_views_agree_with_the_diff(spark):
    old, new = snapshot(spark, random_rows(1)), snapshot(spark, random_rows(2))
    diff = delta.diff_snapshots(new, old)
    for kind, view in (
        ("NEW", delta.new_projects),
        ("REMOVED", delta.removed_projects),
        ("UPDATED", delta.updated_projects),
    ):
        expected = {(r.source_queue_id, r.project_key) for r in diff.filter(F.col("delta_type") == kind).collect()}
        assert {(r.source_queue_id, r.project_key) for r in view(new, old).collect()} == expected


def test_only_the_raw_row_changed(spark):
    old = snapshot(spark, [("a", "k", 5, "Active")])
    new = old.withColumn("record_fingerprint", F.lit("other"))
    assert delta.diff_snapshots(new, old).first().changed_fields == ["SourceRow"]


def test_baseline_is_per_source_and_sampled(spark):
    rows = [("new", f"k{i:02d}", i % 5, "Active") for i in range(30)] + [("old", "k", 5, "Active")]
    current = snapshot(spark, rows)
    previous = snapshot(spark, [("old", "gone", 1, "Active")])
    deltas = delta.compare(current, previous, manifest(spark, "old"), 25)
    kinds = {(r.source_queue_id, r.delta_type): r["count"] for r in deltas.groupBy("source_queue_id", "delta_type").count().collect()}
    assert kinds == {("new", "BASELINE"): 25, ("old", "NEW"): 1, ("old", "REMOVED"): 1}
    # Zero ranks below everything, ties keep their first-seen order.
    ranked = deltas.filter("delta_type = 'BASELINE'").orderBy("delta_rank").collect()
    order = sorted(rows[:30], key=lambda r: -(r[2] or -1))[:25]
    assert [r.project_key for r in ranked] == [r[1] for r in order]
    summary = {r.source_queue_id: r for r in delta.delta_summary(deltas, current, manifest(spark, "old")).collect()}
    assert (summary["new"].baseline_records, summary["new"].baseline_sample) == (30, 25)
    assert (summary["old"].baseline_records, summary["old"]["new"], summary["old"].removed) == (0, 1, 1)
    counters = {r.source_queue_id: r for r in delta.run_counters(delta.delta_summary(deltas, current, manifest(spark, "old")), delta.selected(deltas)).collect()}
    assert (counters["new"].record_count, counters["new"].delta_count, counters["new"].persisted_count) == (30, 25, 25)


def test_selection_order_and_cut(spark):
    old = snapshot(spark, [("s", f"r{i}", i, "Active") for i in range(5)] + [("s", "u", 1, "Active")])
    new = snapshot(spark, [("s", f"n{i}", 10 * i, "Active") for i in range(5)] + [("s", "u", 2, "Active")])
    deltas = delta.compare(new, old, manifest(spark, "s"))
    got = [r.project_key for r in delta.selected(deltas, 8).orderBy("delta_rank").collect()]
    assert got == ["r4", "r3", "r2", "r1", "r0", "n4", "n3", "n2"]


def test_absent_sources_are_left_alone(spark):
    previous = snapshot(spark, [("a", "k", 1, "Active"), ("b", "k", 1, "Active")])
    current = snapshot(spark, [("a", "k", 1, "Active")])
    kept = delta.current_sources(previous, current)
    assert delta.diff_snapshots(current, kept).isEmpty()


def test_history_matches_pairwise_diffs(spark):
    parts = [snapshot(spark, random_rows(s)) for s in (1, 2, 3)]
    records = None
    for seq, part in enumerate(parts, 1):
        part = part.withColumn("snapshot_seq", F.lit(seq).cast("bigint"))
        # Source b has no third snapshot.
        part = part.filter("source_queue_id = 'a'") if seq == 3 else part
        records = part if records is None else records.unionByName(part)
    steps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)], "source_queue_id string, snapshot_seq bigint")
    shown = ["source_queue_id", "project_key", "delta_type", "changed_fields"]
    got = {(r.snapshot_seq, *map(str, r[:4])) for r in chains.history_deltas(records, steps).select(*shown, "snapshot_seq").collect()}
    expected = {(2, *map(str, r)) for r in delta.diff_snapshots(parts[1], parts[0]).select(*shown).collect()}
    third = [p.filter("source_queue_id = 'a'") for p in parts]
    expected |= {(3, *map(str, r)) for r in delta.diff_snapshots(third[2], third[1]).select(*shown).collect()}
    assert got == expected


def test_payload_reads_records_once_and_agrees_with_history(spark):
    """The records of changes meet them by project: one read and one shuffle of whole records."""
    parts = [snapshot(spark, random_rows(s)).withColumn("snapshot_seq", F.lit(s).cast("bigint")) for s in (1, 2, 3)]
    records = parts[0].unionByName(parts[1]).unionByName(parts[2])
    versions = records.select("source_queue_id", "snapshot_seq").distinct()
    changes = chains.steps(records, versions)
    shown = ["source_queue_id", "project_key", "snapshot_seq", "delta_type", "changed_fields", "capacity_mw", "status"]
    got = chains.with_payload(changes, records).select(*shown).collect()
    assert sorted(got) == sorted(chains.history_deltas(records, versions).select(*shown).collect())
    assert {r.delta_type for r in got} == {"NEW", "UPDATED", "REMOVED"}
    stored = spark.createDataFrame(changes.collect(), changes.schema)
    plan = chains.with_payload(stored, records.coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition 1,") == 1


def test_lookup_joins_keep_the_facts(spark):
    facts = spark.range(500).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source_queue_id"),
        "id",
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("m"),
    )
    lookup = spark.createDataFrame([("hot", 1), ("s0", 2), ("s3", 3)], "source_queue_id string, v int")
    found = facts.filter("source_queue_id in ('hot', 's0', 's3')").count()
    sizes = {how: join_lookup(facts, lookup, ["source_queue_id"], how).count() for how in ("left", "inner", "left_semi", "left_anti")}
    assert sizes == {"left": 500, "inner": found, "left_semi": found, "left_anti": 500 - found}
    with pytest.raises(ValueError):
        join_lookup(facts, lookup, ["source_queue_id"], "right")


@pytest.mark.parametrize("lanes", [1, 3, 64])
def test_top_per_group_does_not_depend_on_lanes(spark, lanes):
    rows = spark.range(0, 3000, 1, 11).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 10).cast("string")).alias("g"),
        (F.col("id") * 7919 % 101).alias("v"),
        "id",
    )
    got = top_per_group(rows, ["g"], [F.col("v").desc(), F.col("id")], 5, "r", lanes).collect()
    expected = {}
    for r in rows.collect():
        expected.setdefault(r.g, []).append((-r.v, r.id))
    for g, items in expected.items():
        best = [i for _, i in sorted(items)[:5]]
        assert [r.id for r in sorted(got, key=lambda r: r.r) if r.g == g] == best


def _ranked_rows(spark):
    """A hot group with a third of the rows, half of them of one measure, a null group, a tiny one."""
    key = F.col("id")
    return spark.range(0, 6000, 1, 11).select(
        F.when(key % 3 == 0, "hot").when(key % 3 == 1, F.lit(None)).when(key == 5, "tiny").otherwise((key % 4).cast("string")).alias("g"),
        F.when(key % 2 == 0, 0).otherwise(key * 7919 % 1009 * (key % 5)).alias("v"),
        "id",
        F.repeat(F.lit("x"), 50).alias("payload"),
    )


@pytest.mark.parametrize("limit", [1, 40, 700, 1000, 5000])
def test_large_limits_go_by_ranges(spark, monkeypatch, limit):
    from tidemark.operators import ranking

    rows = _ranked_rows(spark)
    order = [F.col("v").desc(), F.col("id")]
    wanted = {(r.g, r.id, r.r) for r in top_per_group(rows, ["g"], order, limit, "r").collect()}
    monkeypatch.setattr(ranking, "LARGE_LIMIT", 1)
    got = top_per_group(rows, ["g"], order, limit, "r", measure=-F.col("v"))
    assert got.columns == [*rows.columns, "r"]
    found = [(r.g, r.id, r.r) for r in got.collect()]
    assert len(found) == len(wanted) and set(found) == wanted
    plain = top_per_group(rows, ["g"], order, limit, measure=-F.col("v"))
    assert plain.columns == rows.columns and {(r.g, r.id) for r in plain.collect()} == {(g, i) for g, i, _ in wanted}
    assert top_per_group(rows.limit(0), ["g"], order, limit, "r", measure=-F.col("v")).isEmpty()


def test_only_reached_ranges_are_sent(spark):
    """Of a group far above its limit few ranges are left, and none but the last holds rows beyond it."""
    from tidemark.operators.ranking import cut_ranges

    rows = spark.range(0, 100_000, 1, 8).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 100_003).alias("v"))
    _, reached = cut_ranges(rows, ["g"], F.col("v"), 5000)
    places = sorted((r._range, r._before) for r in reached.collect())
    assert len(places) <= 5 and places[0] == (0, 0) and places[-1][1] < 5000


def test_hot_groups_are_not_sent_by_group(spark):
    """Rows meet their group's bounds where they are: only rows that are near the limit are shuffled.
    A group of no more than the limit needs no bounds and stays whole, also that of null."""
    from tidemark.operators.ranking import cut_ranges, top_per_group

    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold").alias("g"),
        (F.col("id") * 7919 % 100_003).alias("v"),
    )
    bounds, _ = cut_ranges(rows, ["g"], F.col("v"), 5000)
    assert [r.g for r in bounds.collect()] == ["hot"]
    top = top_per_group(rows, ["g"], [F.col("v")], 5000, "place", measure=F.col("v"))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted((r.g or "", r["count"]) for r in top.groupBy("g").count().collect()) == [
        ("", 3000), ("cold", 3000), ("hot", 5000),
    ]


def test_selected_deltas_by_ranges(spark, monkeypatch):
    from tidemark.operators import ranking

    key = F.col("id")
    deltas = spark.range(0, 3000, 1, 5).select(
        F.when(key % 3 == 0, "hot").otherwise((key % 10).cast("string")).alias("source_queue_id"),
        F.concat(F.lit("P"), key.cast("string")).alias("project_key"),
        F.get(F.array(*[F.lit(x) for x in ("REMOVED", "NEW", "UPDATED")]), (key % 3 + key % 2).cast("int") % 3).alias("delta_type"),
        F.when(key % 7 > 0, key * 31 % 500 - 20).alias("capacity_mw"),
    )
    wanted = {tuple(r) for r in delta.select_deltas(deltas, 120).collect()}
    monkeypatch.setattr(ranking, "LARGE_LIMIT", 1)
    got = delta.select_deltas(deltas, 120).collect()
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


def test_upsert_replaces_same_identity(spark):
    schema = "queue_id string, source_queue_id string, project_key string, observed_at string, parsed_at string, status string"
    old = spark.createDataFrame([("a-1", "a", "1", "t1", "p1", "old"), ("a-2", "a", "2", "t1", "p1", "old")], schema)
    new = spark.createDataFrame([("a-1", "a", "1", "t1", "p2", "new"), ("a-1", "a", "1", "t2", "p2", "later")], schema)
    got = sorted((r.queue_id, r.observed_at, r.status) for r in insights.upsert_insights(old, new).collect())
    assert got == [("a-1", "t1", "new"), ("a-1", "t2", "later"), ("a-2", "t1", "old")]
