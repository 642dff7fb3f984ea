"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions over the words joined
by single spaces, so line breaks and punctuation never matter. There are rules for statements (a
license's name after words such as "released under", in an SPDX expression, or by itself), for the
bodies and file headers of licenses, and for exceptions. A rule runs only where one of its
keywords stands in the words, those of a name only where the name does, and words are only made
where a keyword of any rule stands in the text; no base phrase can stand in a text without one.
Detections are resolved by priority: one that lies inside another of at least its own priority is
dropped (of two equal ones the earlier rule stays), in one sweep per priority. The base phrases are
exact word sequences, counted apart; their labels always stay.

Null text counts as empty: no words, no labels, score 0. Nothing is cut short in long texts. Every
row of the input gives one row, so repeated rows give repeated results; an empty table gives an
empty result. Columns other than doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import batches_of

#: The phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: License, gate keywords (one of them stands in every match), and its name as a pattern over normalised words.
NAMES = """
mit | mit,expat,x11 | (?:the )?(?:mit|expat|x11)(?: x11)?(?: license)?
mit-0 | mit | mit no attribution(?: license)?|mit 0
apache-1.1 | apache | (?:the )?apache(?: software)? license (?:version |v )?1 1
apache-2 | apache | (?:the )?apache(?: software)? license (?:version |v )?2(?: 0)?|apache 2(?: 0)?
gpl-1 | gpl | (?:gnu )?gpl ?v?(?:ersion )?1(?: 0)?
gpl-2 | gpl | (?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?
gpl-3 | gpl | (?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?
gpl-2 | general | (?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )2
gpl-3 | general | (?:the )?(?:gnu )?general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )3
gpl | general | (?:the )?(?:gnu )?general public license
lgpl-2 | lesser,library | (?:the )?(?:gnu )?(?:lesser|library) general public license (?:version |v )2(?: 0)?
lgpl-2.1 | lesser | (?:the )?(?:gnu )?lesser general public license (?:version |v )2 1
lgpl-3 | lesser | (?:the )?(?:gnu )?lesser general public license (?:version |v )3
lgpl | lgpl | (?:gnu )?lgpl(?: ?v?[23](?: [01])?)?
agpl-3 | affero | (?:the )?(?:gnu )?affero general public license(?: (?:version |v )?3)?
agpl-3 | agpl | (?:gnu )?agpl ?v?(?:ersion )?3?(?: 0)?
gfdl | documentation | (?:the )?(?:gnu )?free documentation license(?: (?:version |v )?1 [123])?
bsd-2-clause | bsd | (?:the )?(?:simplified|freebsd|2 clause) bsd(?: license)?|bsd 2 clause(?: license)?
bsd-3-clause | bsd | (?:the )?(?:new|modified|revised|3 clause) bsd(?: license)?|bsd 3 clause(?: license)?
bsd-4-clause | bsd | (?:the )?(?:original|old|4 clause) bsd(?: license)?|bsd 4 clause(?: license)?
bsd | bsd | (?:the )?bsd(?: style)? licen[sc]e
0bsd | 0bsd,zero | 0bsd|zero clause bsd
isc | isc | (?:the )?isc licen[sc]e
mpl-1.1 | mozilla | (?:the )?mozilla public license (?:version |v )?1 1
mpl-2 | mozilla | (?:the )?mozilla public license(?: (?:version |v )?2(?: 0)?)?
mpl-2 | mpl | mpl ?v?2(?: 0)?
epl-1 | eclipse | (?:the )?eclipse public license (?:version |v )?1(?: 0)?
epl-2 | eclipse | (?:the )?eclipse public license(?: (?:version |v )?2(?: 0)?)?
cddl-1 | cddl,distribution | cddl(?: 1 [01])?|common development and distribution license
cpl-1 | common | (?:the )?common public license(?: (?:version |v )?1(?: 0)?)?
eupl-1.2 | european | (?:the )?european union public licen[sc]e(?: (?:version |v )?1 [12])?
artistic-1 | artistic | (?:the )?artistic license (?:version |v )?1(?: 0)?
artistic-2 | artistic | (?:the )?artistic license(?: (?:version |v )?2(?: 0)?)?
bsl-1 | boost | (?:the )?boost software license(?: (?:version |v )?1(?: 0)?)?
zlib | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
cc0-1 | cc0 | cc0(?: 1(?: 0)?)?(?: universal)?
cc-by | attribution | creative commons attribution(?: (?:2|3|4) [05])?(?: (?:international|unported|generic))?
cc-by-sa | attribution | creative commons attribution share ?alike(?: (?:2|3|4) [05])?
cc-by-nc | attribution | creative commons attribution non ?commercial(?: (?:2|3|4) [05])?
cc-by-nd | attribution | creative commons attribution no ?deriv(?:ative)?s?(?: (?:2|3|4) [05])?
cc-by-nc-sa | attribution | creative commons attribution non ?commercial share ?alike(?: (?:2|3|4) [05])?
cc-by-nc-nd | attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: (?:2|3|4) [05])?
cc-by | cc | cc by(?: [234] [05])?
cc-by-sa | cc | cc by sa(?: [234] [05])?
cc-by-nc | cc | cc by nc(?: [234] [05])?
cc-by-nd | cc | cc by nd(?: [234] [05])?
cc-by-nc-sa | cc | cc by nc sa(?: [234] [05])?
cc-by-nc-nd | cc | cc by nc nd(?: [234] [05])?
ofl-1.1 | ofl | (?:sil )?ofl(?: 1 1)?
ofl-1.1 | font | (?:the )?(?:sil )?open font license(?: (?:version |v )?1 1)?
odbl-1 | database | (?:the )?open (?:data commons )?(?:open )?database license(?: (?:version |v )?1(?: 0)?)?
postgresql | postgresql | (?:the )?postgresql licen[sc]e
python-2 | python | (?:the )?python software foundation license(?: (?:version |v )?2)?
php-3 | php | (?:the )?php license(?: (?:version |v )?3(?: 0[01]?)?)?
ruby | ruby | (?:the )?ruby licen[sc]e
openssl | openssl | (?:the )?openssl licen[sc]e
ncsa | illinois | university of illinois ncsa open source license
upl-1 | universal | (?:the )?universal permissive license(?: (?:version |v )?1(?: 0)?)?
afl-3 | academic | (?:the )?academic free license(?: (?:version |v )?3(?: 0)?)?
osl-3 | osl,software | open software license(?: (?:version |v )?3(?: 0)?)?|osl 3 0
ms-pl | microsoft | (?:the )?microsoft public license
blueoak-1 | blue | (?:the )?blue oak model license(?: 1 0 0)?
sspl-1 | server | (?:the )?server side public license(?: (?:version |v )?1)?
busl-1.1 | business | (?:the )?business source license(?: (?:version |v )?1 1)?
elastic-2 | elastic | (?:the )?elastic license(?: (?:version |v )?2(?: 0)?)?
public-domain | domain | (?:the )?public domain
proprietary | reserved | all rights reserved
classpath-exception-2 | classpath | classpath exception(?: 2 0)?
gcc-exception-3.1 | gcc | gcc (?:runtime library )?exception(?: 3 1)?
llvm-exception | llvm | llvm exception
autoconf-exception | autoconf | autoconf exception(?: [23] 0)?
bison-exception-2.2 | bison | bison exception(?: 2 2)?
font-exception-2 | font | font exception(?: 2 0)?
linking-exception | linking | (?:static |dynamic )?linking exception
"""

#: License, gate keywords and a sentence of its body or file header, over normalised words.
BODIES = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit-0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | advertising | except as contained in this notice the names? of .{1,80}? shall not be used in advertising
ncsa | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
bsl-1 | hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
isc | hereby | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | hereby | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted(?! provided)
postgresql | hereby | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | hereby | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
upl-1 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software associated documentation and or data
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met (?:1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer (?:2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution(?! (?:3 )?(?:neither|all advertising))
bsd-3-clause | endorse | neither the names? of .{1,160}? may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | apache | apache license version 2 0 january 2004
apache-1.1 | apache | this product includes software developed by the apache software foundation
gpl-1 | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 1
gpl-2 | redistribute | this (?:program|software|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2
gpl-3 | redistribute | this (?:program|software|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3
lgpl-2.1 | redistribute | this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
lgpl-2 | redistribute | this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation (?:either )?version 2
lgpl-3 | redistribute | this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3
agpl-3 | redistribute | this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3
gpl-2 | june | gnu general public license version 2 june 1991
gpl-3 | june | gnu general public license version 3 29 june 2007
lgpl-2.1 | february | gnu lesser general public license version 2 1 february 1999
lgpl-3 | june | gnu lesser general public license version 3 29 june 2007
agpl-3 | november | gnu affero general public license version 3 19 november 2007
gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
epl-1 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2 | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2 0
cddl-1 | cddl,distribution | the contents of this file are subject to the terms of the common development and distribution license
artistic-1 | intent | the intent of this document is to state the conditions under which a package may be copied
artistic-2 | establishes | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
zlib | liable | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | you just do what the fuck you want to
cc0-1 | waived | has waived all copyright and related or neighboring rights to
ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
python-2 | python | psf is making python available to licensee on an as is basis
openssl | openssl | this product includes software developed by the openssl project
blueoak-1 | contributors | this license gives everyone as much permission to work with this software as possible while protecting contributors from liability
proprietary | confidential | this software is (?:the )?confidential and proprietary information of
"""

#: What stands before a later name of an SPDX expression.
EXPRESSION = r"spdx license identifier (?:[^ ]+ ){1,24}?(?:or|and|with) "

#: How a license is stated: words before and after its name, priority, confidence.
STATEMENTS = (
    (r"spdx license identifier ", r"", 50, 1.0),
    (EXPRESSION, r"", 50, 1.0),
    (r"(?:is |are )?(?:dual )?(?:licen[sc]ed|relicen[sc]ed) (?:to you )?(?:under|by|with)(?: the terms (?:and conditions )?of)? ", r"", 40, 0.95),
    (r"(?:is |are )?(?:released|distributed|published|available|provided|made available|redistributed|covered)(?: to the public)? (?:under|by|into)(?: the terms (?:and conditions )?of)? ", r"", 40, 0.9),
    (r"(?:under|subject to) the (?:terms|conditions|terms and conditions|provisions) of ", r"", 35, 0.85),
    (r"", r"", 10, 0.5),
)

#: Priority and confidence of a license's own sentences.
BODY = (60, 1.0)


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float
    #: The part of a match that is detected: the whole, or, in an SPDX expression, this one of its names.
    part: int = 0


@dataclass(frozen=True)
class Signature:
    """A name or sentence, its gate keywords, and the rules that it is part of every match of."""

    keywords: tuple[str, ...]
    core: re.Pattern
    rules: tuple[Rule, ...]


def _lines(table: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    for line in table.strip().splitlines():
        label, keywords, pattern = (part.strip() for part in line.split(" | ", 2))
        yield label, tuple(keywords.split(",")), pattern


@lru_cache(maxsize=1)
def signatures() -> tuple[Signature, ...]:
    """All rules in order: license bodies, then every license by every way of stating it."""
    found = []
    for label, keywords, sentence in _lines(BODIES):
        core = re.compile(rf"(?<![^ ])(?:{sentence})(?![^ ])")
        found.append(Signature(keywords, core, (Rule(label, keywords, core, *BODY),)))
    for label, keywords, name in _lines(NAMES):
        stated = []
        for before, after, priority, confidence in STATEMENTS:
            # A bare name counts only if it can't be an everyday word.
            if not before and not re.search(r"licen|gpl|agpl|apache|cc |cc0|bsd|spdx|mpl|wtfpl|cddl|ofl|domain|reserved|creative|exception", name):
                continue
            bare_mit = not before and label in ("mit", "unlicense")
            pattern = r"(?:the )?(?:mit|expat|x11) licen[sc]e" if bare_mit and label == "mit" else name
            whole = re.compile(rf"(?<![^ ]){before}({pattern}){after}(?![^ ])")
            stated.append(Rule(label, keywords, whole, priority, confidence, int(before == EXPRESSION)))
        core = r"(?:mit|expat|x11)" if label == "mit" else f"(?:{name})"
        found.append(Signature(keywords, re.compile(rf"(?<![^ ]){core}(?![^ ])"), tuple(stated)))
    return tuple(found)


def rules() -> tuple[Rule, ...]:
    return tuple(rule for signature in signatures() for rule in signature.rules)


@lru_cache(maxsize=1)
def gates() -> tuple[bytes, ...]:
    """The keywords of all rules: a text without any of them is not looked at further."""
    return tuple(keyword.encode() for keyword in all_keywords())


@lru_cache(maxsize=1)
def all_keywords() -> tuple[str, ...]:
    return tuple(dict.fromkeys(keyword for signature in signatures() for keyword in signature.keywords))


_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BASE = tuple(
    (re.compile(rf"(?<![^ ]){phrase}(?![^ ])"), label) for phrase, label in PHRASES.items()
)
_WORD_BYTE = np.zeros(256, np.bool_)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x41:0x5B] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True


def count_words(raw: bytes) -> int:
    """Number of words; upper-case letters count as the lower-case ones they become."""
    inside = _WORD_BYTE[np.frombuffer(raw, np.uint8)]
    return int(inside[:1].sum()) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def detections(words: str) -> list[tuple[int, int, Rule]]:
    """Surviving detections (start, end, rule), offsets in the joined words."""
    held = {keyword for keyword in all_keywords() if keyword in words}
    levels: dict[int, list[tuple]] = {}
    order = 0
    for signature in signatures():
        order += 1
        if held.isdisjoint(signature.keywords) or not signature.core.search(words):
            continue
        for rank, rule in enumerate(signature.rules):
            hits = levels.setdefault(rule.priority, [])
            hits += [(*m.span(rule.part), order, rank, rule) for m in rule.pattern.finditer(words)]
    return resolved(levels)


def resolved(levels: dict[int, list[tuple]]) -> list[tuple[int, int, Rule]]:
    """What lies inside nothing of its own priority or more. Hits are (start, end, .., rule).

    One sweep by start for each priority, longer hits of one start first, with the furthest end so
    far: a hit lies inside an earlier one just when that reaches its end."""
    kept: list[tuple[int, int, Rule]] = []
    for priority in sorted(levels, reverse=True):
        higher, reach, mine = 0, -1, []
        for start, end, *_, rule in sorted(levels[priority], key=lambda hit: (hit[0], -hit[1], *hit[2:-1])):
            while higher < len(kept) and kept[higher][0] <= start:
                reach = max(reach, kept[higher][1])
                higher += 1
            if end > reach:
                mine.append((start, end, rule))
                reach = end
        kept = sorted(kept + mine, key=lambda hit: hit[:2])
    return kept


def scan_text(raw: bytes | None) -> dict:
    """The result columns of one text, given as UTF-8."""
    raw = raw or b""
    row = {
        "n_words": count_words(raw),
        "n_base": 0,
        "first_word": None,
        "last_word": None,
        "base_labels": "",
        "labels": "",
        "score": 0.0,
    }
    low = raw.lower()
    for gate in gates():
        if gate in low:
            break
    else:
        return row
    words = b" ".join(_WORDS.findall(low)).decode("utf-8", "replace")
    base, starts = set(), []
    for pattern, label in _BASE:
        for m in pattern.finditer(words):
            base.add(label)
            starts.append(m.start())
    found = detections(words)
    row |= {
        "n_base": len(starts),
        "first_word": words.count(" ", 0, min(starts)) if starts else None,
        "last_word": words.count(" ", 0, max(starts)) if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {rule.label for _, _, rule in found})),
        "score": max([1.0] * bool(base) + [rule.confidence for _, _, rule in found], default=0.0),
    }
    return row


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double"
)
_ARROW = pa.schema(
    [(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t])
     for n, t in (x.split() for x in SCHEMA.split(", "))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        rows = ({"doc_id": i} | scan_text(t) for i, t in zip(ids, texts, strict=True))
        yield from batches_of(rows, _ARROW, 4096)


def scan_licenses(documents: DataFrame) -> DataFrame:
    """License phrases and labels of every document, one pass, no shuffle."""
    return documents.select("doc_id", "text").mapInArrow(_scan, SCHEMA)
