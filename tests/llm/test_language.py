import zlib

import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import language

SYLLABLES = {
    "en": "the ing er an re on at ent ion th sh ou".split(),
    "de": "sch ung ein ich keit ver zu der ü ä pf".split(),
    "fr": "eau oi ment que é è tion aux les ou".split(),
    "es": "ción que os ar lla ñ í ado mente ue".split(),
}


def sentence(lang, seed, words=40):
    import random

    rng = random.Random(f"{lang} {seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    langs = sorted(SYLLABLES)
    return [(i, sentence(langs[i % 4], i), langs[i % 4], "s", 0) for i in range(600)]


def test_held_out_accuracy(docs, rows):
    truth = {r[0]: r[2] for r in rows}
    out = language.identify(docs(rows)).collect()
    assert len(out) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_only_the_text_counts(docs, rows):
    text = sentence("fr", 12345)
    more = [(90_000 + i, text, lang, source, 0) for i, (lang, source) in enumerate([("en", "x"), (None, None), ("de", "y")])]
    out = [r for r in language.identify(docs(rows + more)).collect() if r.doc_id >= 90_000]
    assert len({(r.lang_pred, r.score) for r in out}) == 1


def test_held_out_labels_are_not_learned(docs):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2][:20]
    others = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    rows = [(i, sentence("en", i), "en", "s", 0) for i in others] + [(i, sentence("fr", i), "fr", "s", 0) for i in held]
    assert {r.lang_pred for r in language.identify(docs(rows)).collect()} == {"en"}


def test_family_first(docs, rows):
    model = language.train(docs(rows))
    assert model.family_names == ["germanic", "romance"]
    assert model.pairs == [("de", "en"), ("es", "fr")]


def test_odd_rows(docs, prose, rows):
    frame = docs(odd_rows(prose) + [(r[0] + 1000, *r[1:]) for r in rows], clash=True)
    out = [r for r in language.identify(frame).collect() if r.doc_id is None or r.doc_id < 8]
    by_id = {r.doc_id: r for r in out}
    assert {by_id[i].lang_pred for i in (1, 2, 3, 7)} == {"und"} and by_id[1].score == 0.0
    kept = language.with_language(frame)
    assert kept.columns == frame.columns
    gone = {r.doc_id for r in frame.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {1, 2, 3, 7}
    told = {r.doc_id: r.lang_pred for r in out}
    assert {r.doc_id: r.lang for r in kept.collect() if r.doc_id is None or r.doc_id < 8} == {d: told[d] for d in (None, 4, 5, 6)}


def test_nothing_to_learn(docs):
    assert language.identify(docs([])).collect() == []
    assert language.identify(docs([(1, "abc", None, "s", 0)])).first().lang_pred == "und"
    alone = language.identify(docs([(1, "abc", "en", "s", 0), (4, "123", "en", "s", 0)])).collect()
    assert {r.doc_id: r.lang_pred for r in alone} == {1: "en", 4: "und"}


def test_unknown_codes_and_many_of_a_family(docs):
    rows = [(i, sentence("en", i), "xx", "s", 0) for i in range(60)] + [(100 + i, sentence("fr", i), "fr", "s", 0) for i in range(60)]
    rows += [(200 + i, sentence("es", i), "es", "s", 0) for i in range(60)] + [(300 + i, sentence("de", i), "pt", "s", 0) for i in range(60)]
    truth = {r[0]: r[2] for r in rows}
    out = language.identify(docs(rows)).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.95
