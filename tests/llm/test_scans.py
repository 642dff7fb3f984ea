"""Secrets and personal data against plain patterns."""

import hashlib
import math
import random
import re

import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import privacy, secrets


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


def plain_private(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def plain_secrets(text):
    out = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 32:
            out.append((m.start(), 2, "hex", m.end()))
    return sorted(out)


def noisy(seed, alphabet, pieces):
    rng = random.Random(seed)
    return "".join(
        rng.choice(pieces) if rng.random() < 0.3 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        for _ in range(60)
    )


def test_private_patterns():
    pieces = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (234) 555-6789", "+49", "ü@b.cz_d@e.fg", "007.1.1.1", "٣.1.1.1"]
    for seed in range(500):
        text = noisy(seed, "ab1 2.@+-_(é\n", pieces)
        assert sorted(privacy.base_spans(text)) == plain_private(text), text


def test_secret_patterns():
    pieces = ["password=hunter2hunter2", 'TOKEN": "abcd1234efgh"', "api_key:x", "apikey = abcdefgh", "AKIAABCDEFGHIJKL", "AKIA12",
              "deadbeef" * 4, "deadbeef" * 3 + "abcdef1", "ſecret=aaaaaaaaaa", "secret  :  'zzzzzzzzz'"]
    for seed in range(500):
        text = noisy(seed, "ab1 =:\"'fAé\n", pieces)
        assert sorted(secrets.find_spans(text)[0]) == plain_secrets(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "a@" * 100_000, "+1" * 100_000, "password " * 30_000):
        privacy.base_spans(text)
        secrets.find_spans(text)


def test_private_rows(docs, prose):
    texts = [prose(i, 40) + f" mail a{i}@b.example.com or +1 (212) 555-01{i % 100:02d} " + prose(i + 500, 9) for i in range(30)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    for r in privacy.find_private(docs(rows + odd_rows(prose)[:1], clash=True)).collect():
        if r.n_email:
            spans = plain_private(texts[r.doc_id])
            assert r.base_sha256 == digest(spans)
            assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_revealing_terms_are_found_and_masked(docs, prose):
    """A name that stands beside one address in several surroundings gives it away."""
    rows = [(i, f"{prose(i, 30)} Zebediah jz@corp.example.com {prose(i + 99, 30)}", "en", "s", 0) for i in range(6)]
    rows += [(100 + i, f"{prose(300 + i, 30)} other{i}@corp.example.com {prose(400 + i, 30)}", "en", "s", 0) for i in range(40)]
    rows += [(200 + i, prose(700 + i, 60), "en", "s", 0) for i in range(20)]
    # Copies of one text are one surrounding.
    rows += [(300 + i, f"{prose(800, 30)} Solomon copy@corp.example.com {prose(801, 30)}", "en", "s", 0) for i in range(30)]
    frame = docs(rows)
    terms = {r.doc_id: r.spans for r in privacy.find_private(frame).collect() if "term" in r.spans}
    assert set(terms) == set(range(6))
    masked = {r.doc_id: r.text for r in privacy.masked(frame).collect()}
    assert all("Zebediah" not in masked[i] and "@" not in masked[i] and "[TERM] [EMAIL]" in masked[i] for i in range(6))
    assert all("Solomon [EMAIL]" in masked[300 + i] for i in range(30))
    assert all(masked[200 + i] == prose(700 + i, 60) for i in range(20))


@pytest.mark.parametrize("values", ["jz@corp.example.com, +12125550143", "+12125550143, 4111111111111111, jz@corp.example.com"])
def test_a_name_beside_several_values_counts_once(docs, prose, values):
    """Contact blocks: one occurrence of the name stands beside two and three values at once."""
    rows = [(i, f"{prose(i, 30)} Zebediah {values} {prose(i + 99, 30)}", "en", "s", 0) for i in range(6)]
    rows += [(100 + i, f"{prose(300 + i, 30)} other{i}@corp.example.com {prose(400 + i, 30)}", "en", "s", 0) for i in range(40)]
    frame = docs(rows)
    assert {r.doc_id for r in privacy.find_private(frame).collect() if "term" in r.spans} == set(range(6))
    masked = {r.doc_id: r.text for r in privacy.masked(frame).collect()}
    assert all("Zebediah" not in masked[i] and "[TERM]" in masked[i] for i in range(6))


def plain_terms(texts, least, threshold):
    """The formula as it stands, over different texts: terms above the threshold."""
    texts = sorted(set(texts))
    values, terms = [], []
    for text in texts:
        spans = plain_private(text)
        values.append({text[a:b] for a, _, _, b in spans})
        words = re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
        terms.append({m[0] for m in words if not any(a < m.end() and m.start() < b for a, _, _, b in spans)})
    out = set()
    for value in set().union(*values):
        with_value = {i for i, v in enumerate(values) if value in v}
        prior = len(with_value) / max(len(texts), len(with_value) + 1)
        for term in set().union(*terms):
            with_term = {i for i, t in enumerate(terms) if term in t}
            both = len(with_term & with_value)
            if both >= least and math.log2(both / len(with_term) / prior) / -math.log2(prior) >= threshold:
                out.add(term)
    return out


def term_spans(text, terms):
    base = plain_private(text)
    return {
        (m.start(), m.end())
        for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)
        if m[0] in terms and not any(a < m.end() and m.start() < b for a, _, _, b in base)
    }


def test_terms_against_brute_force(docs, prose):
    """One to three adjacent values, copies, and texts without values, all occurrences."""
    rng = random.Random(8)
    blocks = ["{n} a{k}@corp.example.com", "{n} a{k}@corp.example.com, +1212555010{k}", "{n}, +1212555010{k}, 4111111111111111, a{k}@corp.example.com",
              "{n} and no address", "a{k}@corp.example.com without"]
    texts = [f"{prose(i, 25, 400)} {rng.choice(blocks).format(n=f'Näme{i % 7}', k=i % 7)} {prose(i + 500, 25, 400)} Näme{i % 7 if i % 3 else 1}." for i in range(90)]
    texts += [prose(900 + i, 40, 400) for i in range(60)] + texts[:20]
    for least, threshold in ((privacy.MIN_CONTEXTS, privacy.THRESHOLD), (1, 0.5)):
        want = plain_terms(texts, least, threshold)
        assert want
        rows = privacy.find_private(docs([(i, t, "en", "s", 0) for i, t in enumerate(texts)]), least, threshold).collect()
        assert len(rows) == len(texts)
        for r in rows:
            got = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term:")}
            assert got == term_spans(texts[r.doc_id], want)


def test_terms_are_masked_wherever_they_stand(docs, prose):
    """As a title far from the address, behind a long rule, and in texts that leave the address out."""
    rows = [(i, f"Zebediah {prose(i, 30)} {'-' * 400} jz@corp.example.com {prose(i + 99, 30)} Zebediah", "en", "s", 0) for i in range(6)]
    rows += [(50, f"{prose(60, 30)} Zebediah {prose(61, 30)}", "en", "s", 0)]
    rows += [(100 + i, prose(300 + i, 60), "en", "s", 0) for i in range(60)]
    frame = docs(rows)
    masked = {r.doc_id: r.text for r in privacy.masked(frame).collect()}
    assert not any("Zebediah" in text for text in masked.values())
    assert masked[50] == rows[6][1].replace("Zebediah", "[TERM]") and masked[100] == rows[7][1]


@pytest.mark.parametrize("texts", [2, 12])
def test_fixed_contact_blocks_count_by_text(docs, prose, texts):
    """The same words around the address in different texts are as many pieces of evidence."""
    block = "Best regards Zebediah chief officer of Corp Ltd jz@corp.example.com Main Street Corp Ltd Old Town"
    rows = [(i, f"{prose(i, 30)} {block} {prose(i + 99, 30)}", "en", "s", 0) for i in range(texts)]
    rows += [(100 + i, prose(300 + i, 60), "en", "s", 0) for i in range(60)]
    masked = {r.doc_id: r.text for r in privacy.masked(docs(rows)).collect()}
    assert not any("Zebediah" in masked[i] for i in range(texts))


def test_masks_overlap(docs):
    text = "ä call +4111 1111 1111 1111 now a@b.cd"
    got = privacy.masked(docs([(1, text, "en", "s", 0)])).first().text
    assert got in ("ä call [PHONE] now [EMAIL]", "ä call +[CARD] now [EMAIL]")


@pytest.mark.parametrize("scan", [privacy.find_private, secrets.scan_secrets])
def test_odd_rows(docs, prose, scan):
    out = scan(docs(odd_rows(prose), clash=True)).collect()
    assert len(out) == 9
    assert {r.base_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}
    assert scan(docs([])).collect() == []


def test_masked_keeps_rows_and_columns(docs, prose):
    frame = docs(odd_rows(prose), clash=True)
    out = privacy.masked(frame)
    assert out.columns == frame.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, frame.collect()))


def test_secret_rows(docs, prose):
    texts = [prose(i, 30) + f" password={'q%d' % i * 6} " + "0123456789abcdef" * 2 for i in range(20)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(50 + i, texts[0], "en", "s", 0) for i in range(9)]
    for r in secrets.scan_secrets(docs(rows)).collect():
        spans = plain_secrets(texts[r.doc_id if r.doc_id < 50 else 0])
        assert r.base_sha256 == digest(spans) and r.n_assign == 1 and r.n_hex == 1


def test_further_secret_kinds():
    text = "key -----BEGIN RSA PRIVATE KEY-----\nMIIabc=\n-----END RSA PRIVATE KEY----- ghp_" + "a1" * 18
    assert [x[2] for x in sorted(secrets.find_spans(text)[1])] == ["pem", "forge"]


def test_ledger_scans_only_what_is_new(spark, docs, tmp_path):
    ledger = secrets.BlobLedger(spark, f"file://{tmp_path}/ledger")
    one = docs([(1, "password=aaaaaaaaaa", "en", "s", 0), (2, "clean", "en", "s", 0), (3, "clean", "en", "s", 0)])
    assert {r.doc_id: r.n_assign for r in secrets.scan_secrets(one, ledger).collect()} == {1: 1, 2: 0, 3: 0}
    assert ledger.findings().count() == 2
    two = one.union(docs([(4, "token: bbbbbbbbbb", "en", "s", 0), (5, "password=aaaaaaaaaa", "en", "s", 0)]))
    assert {r.doc_id: r.n_assign for r in secrets.scan_secrets(two, ledger).collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}
    # The store holds what was added, run by run: two blobs, then one.
    assert spark.read.parquet(ledger.path).count() == 3
    secrets.scan_secrets(two, ledger, "other rules").collect()
    assert spark.read.parquet(ledger.path).count() == 6
