"""Operators that judge one text at a time, against plain Python."""

import hashlib
import io
import re
import time
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from factloom.llm import decontaminate, licenses, media, pii, url_filter
from factloom.llm.license_rules import GATE_WORDS, GATES
from factloom.llm.license_rules import RULES as SIGNATURES

ODD_TEXTS = [None, "", " ", "\n\n\n", "é", "x" * 60_000, "word " * 12_000, "ÀÉ İ ß \U0001f600 text"]


def docs_of(spark, texts, first=0):
    """Documents with repeated rows, and further columns whose names operators use inside."""
    rows = [(first + i, t, i, "noise", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, id int, key string, score double")


# --- URL filters ---------------------------------------------------------------------------------------------------

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("Example.net", "", "block"), ("a.example.net", "/", "allow"), ("org", "/x", "block"), ("org", "/x", "allow")]
URLS = [
    None, "", "no scheme", "http://", "http://example.com/en/74?x#y", "https://EXAMPLE.com/en/8", "http://badexample.com/en/7", "http://a.b.example.com/en/7",
    "ftp://example.net", "http://a.example.net/q", "http://A.EXAMPLE.NET?x=/", "http://h.org/xy", "http://com/en/", "x://y://example.com/en/7", "http://example.com:80/en/7", "http://e.com/" + "p" * 3000,
]


def judge(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h) + len(p), len(h), a == "allow", h + p, a) for h, p, a in ((h.lower(), p, a) for h, p, a in RULES) if f".{host}".endswith(f".{h}") and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [url_filter.BROADCAST_RULES, 0])
def test_urls(spark, limit):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[4], "x"), (4, URLS[4], "x")]
    urls = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("net", "/", None)], "host string, path string, action string")
    got = Counter(tuple(r) for r in url_filter.judge_urls(urls, rules, broadcast_rules=limit).collect())
    assert got == Counter((i, *judge(u)) for i, u, _ in rows)


def test_no_rules_and_no_urls(spark):
    urls = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert [tuple(r) for r in url_filter.judge_urls(urls, rules).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_filter.judge_urls(urls.limit(0), rules).count() == 0


# --- benchmark decontamination -------------------------------------------------------------------------------------


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        row, last = [i], row
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
    return min(row)


def test_myers_is_the_plain_distance():
    rng = np.random.default_rng(0)
    for _ in range(200):
        pattern = [str(x) for x in rng.integers(0, 4, rng.integers(1, 90))]
        text = [str(x) for x in rng.integers(0, 4, rng.integers(0, 120))]
        assert decontaminate.myers(pattern, text)[0] == plain_distance(pattern, text)


def test_leaks_are_all_found(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 40)))) for i in range(25)] + [(99, None), (98, ""), (97, "one two three four")]
    texts = []
    for i in range(80):
        words = list(rng.choice(vocabulary, 60))
        copy = decontaminate.words_of(items[i % 25][1])
        for _ in range(int(rng.integers(0, 8))):
            at = int(rng.integers(0, len(copy))) if copy else 0
            copy[at : at + int(rng.integers(0, 2))] = list(rng.choice(vocabulary, int(rng.integers(0, 2))))
        texts.append(" ".join(words[:30] + copy + words[30:]).replace("w1 ", "W1, "))
    docs, bench = docs_of(spark, texts + ODD_TEXTS), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for r in docs.distinct().collect():
        for key, text in items:
            pattern = decontaminate.words_of(text)
            if pattern:
                d = plain_distance(pattern, decontaminate.words_of(r.text))
                if d <= int(decontaminate.RATE * len(pattern)):
                    want.add((r.doc_id, key, d))
    for block, automaton in ((decontaminate.BLOCK_CHARS, 1 << 40), (300, 1 << 40), (300, 0)):
        rows = decontaminate.leaks(docs, bench, block_chars=block, automaton=automaton).collect()
        assert len(rows) == len(want) + sum(w[0] < 2 for w in want)  # the first two rows are there twice
        assert {(r.doc_id, r.item_id, r.distance) for r in rows} == want
        left = decontaminate.without_leaks(docs, bench, block_chars=block, automaton=automaton)
        assert left.columns == docs.columns
        assert {r.doc_id for r in left.collect()} == set(range(len(texts) + len(ODD_TEXTS))) - {w[0] for w in want}
    assert len({w[0] for w in want}) > 20
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


# --- personal data -------------------------------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


PERSONAL = [
    "a@b.c_x@d.e f@g @h.i j..k@l-m.n.", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.255 9.9.9 0.0.0.0 10.0.0.1 00.1.200.256 0255.1.1.1 256.1.1.1", "é4 4111 1111 1111 1111 é 4111-1111-1111-1112 4111111111111111", "+1 (375) 555-4393 +12 +1234567890123456 +49 30 1234567.",
    "9" * 5000 + " a" * 10, "a." * 3000 + "@x.y", "x@" + "a." * 3000 + "b", "+1 4111111111111111. 1.2.3.4@a.b ",
    " é ".join(f"10.0.{i % 300}.{i % 256} u{i}@x.yz" for i in range(700)),
]


def test_base_spans(spark):
    docs = docs_of(spark, ODD_TEXTS + PERSONAL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.report(pii.find(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in spans) for k in PLAIN)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_contexts_discover_unseen_identifiers(spark):
    known = [f"Please reach staff{i}@mail.example anytime, via {i}.0.0.7 or so." for i in range(1, 9)]
    unseen = ["Please reach user77xx99 anytime, via nothing."]
    clean = [f"In the year 20240{i} about 12345678{i} things of version 1.2.3 were counted." for i in range(8)]
    docs = docs_of(spark, known + unseen + clean)
    spans = {r.doc_id: r.spans for r in pii.report(pii.find(docs)).collect()}
    at = unseen[0].index("user77xx99")
    assert spans[8] == f"id:{at}:{at + 10}"
    assert all(spans[i] == "" for i in range(9, 17))
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[8] == "Please reach <ID> anytime, via nothing." and text[0] == "Please reach <EMAIL> anytime, via <IP> or so." and text[9] == clean[0]


def plain_tokens(text):
    """(start, end, token, left, far, right) of every token that looks like an identifier."""
    text, out, end = text or "", [], 0
    found = list(regex.finditer(pii.TOKEN, text))
    for n, m in enumerate(found):
        before, after = text[end : m.start()], text[m.end() : found[n + 1].start() if n + 1 < len(found) else len(text)]
        end = m.end()
        bare = m[0].strip("@._%+-")
        start = m.start() + len(m[0]) - len(m[0].lstrip("@._%+-"))
        if "@" in bare[1:-1] and not bare.startswith("@") or (len(bare) >= 8 and sum(c.isdigit() for c in bare) >= 2):
            word = lambda x, p: (regex.search(p, x) or [None, ""])[1].lower()
            left = word(before[-48:], r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$")
            far = word(before[-96:], r"([\p{L}\p{N}]++)[^\p{L}\p{N}]++[\p{L}\p{N}]++[^\p{L}\p{N}]*+$")
            out.append((start, start + len(bare), bare, left, far, word(after[:48], r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)")))
    return out


def plain_identifiers(texts):
    """Spans of kind id in each text, by rounds over a plain graph."""
    seen = []
    for n, text in enumerate(texts):
        base = base_spans(text)
        for a, b, token, left, far, right in plain_tokens(text):
            known = any(s < b and a < e for s, _, e, _ in base)
            patterns = [("b", left)] * bool(left) + [("b", far, left)] * bool(left and far) + [("a", right)] * bool(right) + [("r", left, right)] * bool(left and right)
            seen.append((n, a, b, token.lower(), known, patterns))
    known = {t for _, _, _, t, k, _ in seen if k}
    edges = {(t, p) for _, _, _, t, _, ps in seen for p in ps}
    # The score of an instance is 1 if a base span touches it anywhere.
    touched = {(t, p) for _, _, _, t, k, ps in seen for p in ps if k}
    score = {t: float(any(x == t for x, _ in touched)) for t, _ in edges}
    patterns = {}
    for _ in range(pii.ROUNDS):
        met = {}
        for t, p in edges:
            met.setdefault(p, []).append(score.get(t, 0.0))
        patterns = {p: sum(v) / (len(v) + pii.SMOOTHING) for p, v in met.items() if sum(v) >= pii.SUPPORT}
        score = {t: 1.0 if any((t, p) in touched for x, p in edges if x == t and p in patterns) else max((patterns[p] for x, p in edges if x == t and p in patterns), default=0.0) for t, _ in edges}
        score = {t: v if v == 1.0 or v >= pii.CONFIDENT else 0.0 for t, v in score.items()}
    good = {p for p, v in patterns.items() if v >= pii.CONFIDENT}
    out = [set() for _ in texts]
    for n, a, b, _, k, ps in seen:
        if not k and good & set(ps):
            out[n].add((a, b))
    return [sorted(x) for x in out]


def test_all_spans_are_those_of_a_plain_graph(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdeghi"), 5))
    texts = []
    for i in range(40):
        texts.append(f"{word()} write to u{i}@x{i}.example {word()}. Call +49 30 12345{i:02d} {word()}, or see 10.0.0.{i} there.")
        if i % 4 == 0:
            texts.append(f"{word()} write to hidden{i}x{i}@intranet {word()}. Call 030-12345{i:02d} {word()}; see 999.0.0.{i}77 there, {word()} 1234567{i:02d}.")
    texts += PERSONAL[:4] + PERSONAL[7:] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000").limit(60).collect()]
    want = plain_identifiers(texts)
    got = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("id:")] for r in pii.report(pii.find(docs_of(spark, texts))).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum(map(len, want[:50])) >= 20  # what the seeds' contexts discover


def test_dense_texts_take_time_by_length(spark):
    took = []
    for n in (20_000, 60_000):
        docs = spark.createDataFrame([(1, " ".join(f"to 10.0.{i % 256}.{i % 250} or user{i}99 " for i in range(n // 2)))], "doc_id long, text string")
        began = time.time()
        text = pii.redact(docs).first().text
        took.append(time.time() - began)
        assert text.count("<IP>") == n // 2
    assert took[1] < 3 * took[0] + 15


def test_redaction_keeps_rows_and_columns(spark):
    docs = docs_of(spark, ODD_TEXTS + PERSONAL).union(docs_of(spark, ["no id: a@b.c"]).withColumn("doc_id", F.lit(None).cast("long")))
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == docs.count()
    for r in red.where("doc_id IS NULL").collect():
        assert r.text == "no id: <EMAIL>"
    assert pii.redact(docs.limit(0)).count() == 0


# --- licenses ------------------------------------------------------------------------------------------------------

LICENSED = [
    "MIT License MIT\nlicense mit-license", "apache license" * 3, "CC-BY-SA 4.0, CC BY", "GNU General Public License, version 3 or any later. gnu general\tpublic license", "É mit License é", "mit licenses", "mit license " * 50,
    "Licensed under the Apache License, Version 2.0 (the License)", "in the public\ndomain", "SPDX-License-Identifier: BSD 3-Clause License", "ordinary prose with the word license in it",
]


def plain_licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in licenses.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))


def test_license_base(spark):
    docs = docs_of(spark, ODD_TEXTS + LICENSED)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses.scan(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r)[1:6] == plain_licenses(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_rules_and_containment(spark):
    labels = {r.doc_id: r.labels for r in licenses.scan(docs_of(spark, LICENSED)).collect()}
    assert labels[2] == "cc-by,cc-by-sa-4.0"  # the longer name hides the shorter one inside it, the later plain one stays
    assert labels[3] == "gpl,gpl-3.0" and labels[7] == "apache,apache-2.0" and labels[8] == "public-domain" and labels[9] == "bsd-3-clause" and labels[10] == ""
    assert len(licenses.rules()) > 200 and licenses.scan(docs_of(spark, LICENSED).limit(0)).count() == 0


def scan_all_rules(text):
    """Labels and score by every rule on every text, without keywords or gates."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    line = f" {' '.join(words)} "
    found = sorted((m.start(), -len(m[0]), n, label, weight) for n, (label, _, weight, x) in enumerate(SIGNATURES) for m in re.finditer(f" {x}(?= )", line))
    end, labels, score = -1, set(), 0.0
    for start, less, _, label, weight in found:
        if start - less > end:
            end, score = start - less, max(score, weight)
            labels.add(label)
    base = {label for p, label in licenses.BASE if f" {p} " in line}
    return ",".join(sorted(labels | base)), max(score, 0.5 if base else 0.0)


def test_every_rule_is_tried_where_it_could_match(spark):
    plain = lambda x: x.replace("licen[cs]e", "license").replace("[sz]", "s").replace("?", "")
    for _, key, _, x in SIGNATURES:
        assert key in plain(x) and (any(g in plain(x) for g in GATES) or any(" ".join(g) in plain(x) for g in GATE_WORDS)), x
    examples = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\.\{\d+,\d+\}\??", "some of them", plain(x).replace("?:", "?:"))).replace("(", "").replace(")", "").replace(":", "").replace("[", "").replace("]", "") for _, _, _, x in SIGNATURES]
    texts = [*LICENSED, *ODD_TEXTS, *[f"Before. {e.title()}, and after" for e in examples], "\u212a license \u0130 MIT LICENSE", "PUBLIC--DOMAIN in the public\t\tdomain"]
    documents = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for r in licenses.scan(docs_of(spark, texts + documents)).collect():
        assert (r.labels, r.score) == scan_all_rules((texts + documents)[r.doc_id]), (texts + documents)[r.doc_id]


# --- media ---------------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = [*ODD_TEXTS, "a" * 576, "a" * 577, "chirp " * 500]
    docs = docs_of(spark, texts)
    stored = media.encode(docs)
    by_id = {r.doc_id: r for r in stored.collect()}
    for r in media.fingerprints(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        file = bytes(by_id[r.doc_id].media)
        with wave.open(io.BytesIO(file)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest())
    assert media.fingerprints(stored).count() == docs.count() and media.fingerprints(media.encode(docs.limit(0))).count() == 0


def test_fingerprints_tell_of_the_tone(spark):
    t = np.arange(5760)
    low, high = (bytes((128 + 100 * np.sin(2 * np.pi * k * t / media.FRAME)).astype(np.uint8)) for k in (3, 60))
    for tone, band, k in ((low, 0, 3), (high, 4, 60)):
        assert (media.peaks(tone)[:, band] == k).all()
    times, codes = media.pairs(media.peaks(low))
    assert (np.diff(times) >= 0).all() and len(times) == len(codes) > 0


def test_stored_arrays_are_the_plain_pairs(spark):
    """Every stored pair against plain Fourier sums, frame by frame."""
    texts = ["same " * 300, "same " * 300, "other " * 300, "", "chirp and chatter, " * 40]
    rows = {r.doc_id: r for r in media.fingerprints(media.encode(docs_of(spark, texts))).collect()}
    assert rows[0].codes == rows[1].codes != rows[2].codes and rows[0].times == rows[1].times and rows[0].feature == rows[1].feature != rows[2].feature
    n = np.arange(media.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * n / (media.FRAME - 1))
    waves = np.exp(-2j * np.pi * np.outer(np.arange(97), n) / media.FRAME)
    for i, text in enumerate(texts):
        raw = text.encode() + b"\xff" * (-len(text) % 576 if text else 576)
        power = [np.abs(waves @ ((np.frombuffer(raw[a : a + media.FRAME], np.uint8).astype(float) - 128) * window)) for a in range(0, len(raw) - media.FRAME + 1, media.HOP)]
        pairs = list(zip(rows[i].times, rows[i].codes, strict=True))
        assert pairs == sorted(pairs) and len(pairs) == 9 * (len(power) - 1)
        for time_, code in pairs:
            for at, k in ((time_, code >> 16), (time_ + (code & 255), code >> 8 & 255)):
                band = next(b for b in range(5) if media.BANDS[b] <= k < media.BANDS[b + 1])
                assert power[at][k] >= power[at][media.BANDS[band] : media.BANDS[band + 1]].max() - 1.001
