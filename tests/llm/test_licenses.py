import random
import re
from dataclasses import replace

import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import licenses


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in licenses.PHRASES.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({x for _, x in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def test_base_against_brute_force(docs, prose):
    rng = random.Random(3)
    phrases = ["under the MIT\nLicense", "Apache License, Version 2.0", "CC-BY-NC 4.0", "under the mit licensex",
               "apachelicense version 2", "éunder the mit license", "cc by nc", "UNDER THE MIT LICENSE under the mit license"]
    texts = []
    for i in range(200):
        parts = prose(i, 30).split()
        for _ in range(rng.randrange(4)):
            parts.insert(rng.randrange(len(parts)), rng.choice(phrases))
        texts.append(" ".join(parts))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    for r in licenses.scan_licenses(docs(rows)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
        ("Released under the BSD 3-Clause License", "bsd-3-clause"),
        ("available under the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa"),
        ("the permit of the summit", ""),
    ],
)
def test_rules(text, labels):
    assert licenses.scan_text(text.encode())["labels"] == labels


def examples(tree):
    """Shortest texts of a pattern, one for every way through its alternatives."""
    texts = [""]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            ways = [chr(value)]
        elif name == "IN":
            ways = ["z" if str(value[0][0]) == "NEGATE" else chr(value[0][1])]
        elif name in ("ANY", "NOT_LITERAL"):
            ways = ["z"]
        elif name == "BRANCH":
            ways = [x for branch in value[1] for x in examples(branch)]
        elif name == "SUBPATTERN":
            ways = examples(value[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            ways = [x * value[0] for x in examples(value[2])] if value[0] else [""]
        else:
            assert name == "ASSERT_NOT"
            ways = [""]
        texts = [a + b for a in texts for b in ways]
    return texts


def test_gates_lose_no_rule(monkeypatch):
    """Every rule by itself, in all forms of its name, as without gates and keywords."""
    got = {}
    for rule in licenses.rules():
        for text in examples(re._parser.parse(rule.pattern.pattern))[:12]:
            assert rule.pattern.search(text)
            got[text] = licenses.scan_text(text.encode())
    free = tuple(replace(x, keywords=("",), core=re.compile("")) for x in licenses.signatures())
    monkeypatch.setattr(licenses, "signatures", lambda: free)
    monkeypatch.setattr(licenses, "all_keywords", lambda: ("",))
    for text, row in got.items():
        found = licenses.detections(text)
        labels = {rule.label for _, _, rule in found} | set(row["base_labels"].split(",")) - {""}
        assert labels and row["labels"] == ",".join(sorted(labels)), text


@pytest.mark.parametrize(
    "text, label, score",
    [
        ("Released under MIT.", "mit", 0.9),
        ("distributed under the terms of the X11", "mit", 0.9),
        ("made available under Expat", "mit", 0.9),
        ("released under MIT-0", "mit-0", 0.9),
    ],
)
def test_plain_mit_statements(text, label, score):
    row = licenses.scan_text(text.encode())
    assert label in row["labels"].split(",") and row["score"] == score


def test_hundreds_of_rules_and_containment():
    assert len(licenses.rules()) > 200
    found = licenses.detections("licensed under the gnu general public license version 3")
    assert [(r.label, r.priority) for _, _, r in found] == [("gpl-3", 40)]


def kept_by_pairs(hits):
    """Every hit against every one kept before it."""
    kept = []
    for _, start, end, order, name in sorted(hits, key=lambda h: (-h[0], h[1] - h[2], *h[3:])):
        if not any(a <= start and end <= b for a, b, _ in kept):
            kept.append((start, end, name))
    return sorted(kept, key=lambda h: h[:2])


def test_containment_against_all_pairs():
    rng = random.Random(5)
    for _ in range(300):
        hits = set()
        for _ in range(rng.randrange(40)):
            start = rng.randrange(30)
            hits.add((rng.choice([10, 40, 50]), start, start + rng.randrange(1, 9), rng.randrange(4), "x"))
        levels = {}
        for priority, *rest in hits:
            levels.setdefault(priority, []).append(tuple(rest))
        assert licenses.resolved(levels) == kept_by_pairs(hits)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
         'documentation files (the "Software"), to deal in the Software without restriction', "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
         "following conditions are met: 3. Neither the name of the copyright holder nor the names of its contributors may be "
         "used to endorse or promote products derived from this software without specific prior written permission.",
         "bsd,bsd-3-clause"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the "
         "following conditions are met:\n 1. Redistributions of source code must retain the above copyright notice, this list of "
         "conditions and the following disclaimer.\n 2. Redistributions in binary form must reproduce the above copyright notice, "
         "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
         "distribution.\n\nTHIS SOFTWARE IS PROVIDED", "bsd-2-clause"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
         "provided that the above copyright notice appear", "isc"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
         "THE SOFTWARE", "0bsd"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
         "the License.", "apache-2"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
         "License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
        ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "classpath-exception-2,gpl-2"),
        ("redistribution of income in binary terms is hereby discussed", ""),
    ],
)
def test_bodies_and_expressions(text, labels):
    row = licenses.scan_text(text.encode())
    assert row["labels"] == labels and row["score"] == (1.0 if labels else 0.0)


def test_one_phrase_many_times_is_linear():
    import time

    text = b"released under the mit license. " * 80_000
    started = time.monotonic()
    row = licenses.scan_text(text)
    assert time.monotonic() - started < 20
    assert (row["n_base"], row["first_word"], row["last_word"]) == (80_000, 1, 5 * 79_999 + 1)


def test_odd_rows(docs, prose):
    out = {r.doc_id: r for r in licenses.scan_licenses(docs(odd_rows(prose), clash=True)).collect()}
    assert out[1].n_words == 0 and out[1].labels == "" and out[1].score == 0
    assert out[4].n_words == 40_000
    assert licenses.scan_licenses(docs([])).collect() == []
