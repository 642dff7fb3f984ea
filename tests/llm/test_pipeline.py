"""The corpus pipeline, stage by stage, against plain Python."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import CLASHING
from tests.llm.test_language import sentence
from tests.llm.test_minmax import shingle_set
from tidemark.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rows = []
    for i in range(60):
        lang = "en de fr es".split()[i % 4]
        rows.append((i, sentence(lang, i, 60), lang, f"s{i % 7}"))
    for i in range(60, 72):
        words = sentence("en", 1, 60).split()
        if i % 2:
            words[30] = f"copy{i}"
        rows.append((i, " ".join(words), "en", "s1"))
    rows += [(80, None, "en", "s0"), (81, "", None, "s0"), (82, "123 456", "en", "s2"), (83, "!!", "fr", None)]
    rows += [(90, sentence("en", 90, 50) + " write to a.b@c.example.org today", "en", "s3"), (91, sentence("de", 91, 50), "de", None)]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def groups(texts):
    """Smallest id of each group of near copies, by five-word shingles."""
    sets = {d: shingle_set(t, 5) for d, t in texts.items()}
    label = {d: d for d in texts}
    for _ in range(len(texts)):
        for a in texts:
            for b in texts:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gives, on what the one before it has written."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(documents(), DOCS)
    docs.write.parquet(str(folder / "documents.parquet"))
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out[name] = docs.collect()
    out["run"] = corpus_pipeline.run(spark, str(folder)).collect()
    return out


def test_names_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "privacy", "mix", "pack"]
    for name in ("language", "near_dedup", "privacy", "mix"):
        assert stages[name][0].asDict().keys() == stages["documents"][0].asDict().keys()


def test_language_and_near_dedup(stages):
    kept = {r.doc_id: r for r in stages["language"]}
    assert set(kept) == {r.doc_id for r in stages["documents"]} - {80, 81, 82, 83}
    label = groups({d: r.text for d, r in kept.items()})
    assert {r.doc_id for r in stages["near_dedup"]} == set(label.values())
    assert {r.doc_id: r for r in stages["near_dedup"]} == {d: kept[d] for d in set(label.values())}


def test_privacy(stages):
    before, after = ({r.doc_id: r for r in stages[s]} for s in ("near_dedup", "privacy"))
    assert after.keys() == before.keys()
    assert "write to [EMAIL] today" in after[90].text and after[90].n_chars == len(after[90].text)
    assert all(after[d] == before[d] for d in before if d != 90)


def test_mix(stages):
    size = {r.doc_id: len(r.text.split()) for r in stages["privacy"]}
    by_source = defaultdict(int)
    for r in stages["privacy"]:
        by_source[r.source] += size[r.doc_id]
    from tests.llm.test_mixing import brute_targets

    targets = brute_targets(by_source)
    copies = Counter(r.doc_id for r in stages["mix"])
    taken = defaultdict(int)
    for r in stages["privacy"]:
        assert copies[r.doc_id] <= mixing.MAX_EPOCHS
        taken[r.source] += copies[r.doc_id] * size[r.doc_id]
    assert all(abs(taken[s] - targets[s]) <= max(size.values()) for s in targets)


def test_pack_and_run(stages):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokens = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages["mix"])
    assert sum(r.length for r in stages["pack"]) == tokens
    assert sorted((r.doc_id, r.length) for r in stages["run"]) != []
    assert sum(r.length for r in stages["run"]) == tokens


def test_odd_tables(spark, tmp_path):
    """An empty table; repeated rows, shared and missing ids, a very long text and clashing columns."""
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).collect() == []
    texts = [sentence("en de fr es".split()[i % 4], i, 60) for i in range(40)]
    rows = [(i, t, "en de fr es".split()[i % 4], f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [rows[3]] * 3 + [(4, texts[7], "es", "s1", 0), (None, texts[8], "en", "s2", 0), (5, "word " * 60_000, "en", None, 0)]
    rows += [(None, None, None, None, None), (90, "", "en", "s0", 0), (90, "", "en", "s0", 0)]
    frame = spark.createDataFrame(rows, DOCS).select("*", *[F.lit("x").alias(c) for c in (*CLASHING, "mark", "of_doc", "wins")])
    frame.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    docs = frame
    kept = None
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path / "odd"))
        assert docs.columns == frame.columns, name
        docs.write.parquet(str(tmp_path / "odd" / name))
        docs = spark.read.parquet(str(tmp_path / "odd" / name))
        kept = docs
    # Each different text with a letter once; of copies the smallest id: 4 has the text of 7 as well.
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*(set(range(40)) - {7}), 4, 5])
    assert {r.text for r in kept.collect()} == {r[1] for r in rows if r[1]}
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in out} <= set(range(40)) and sum(r.length for r in out) > 60_000
