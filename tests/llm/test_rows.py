"""Operators that judge each document alone: licenses, benchmark passages, toxicity, token counts."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR
from helpers import alnum_words, collected, make_docs, prose

from gridledger.llm import decontaminate, license_scan, textbytes, token_counts, toxicity
from gridledger.llm.queries import QUERIES

BENCHMARK = "item_id long, text string"


def decontaminated(docs, items):
    """Plain search of every window in every document."""
    windows = {}
    for item, text in items:
        words = alnum_words(text)
        width = min(10, len(words))
        for i in range(len(words) - width + 1 if width else 0):
            windows.setdefault(tuple(words[i:i + width]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        words, hit, found = alnum_words(text), set(), set()
        for width in {len(w) for w in windows}:
            for i in range(len(words) - width + 1):
                owners = windows.get(tuple(words[i:i + width]))
                if owners:
                    hit |= set(range(i, i + width))
                    found |= owners
        names = ",".join(sorted(found))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_equals_plain_search(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    got = collected(QUERIES["op2_decontaminate"](spark, SF_DIR), *COLUMNS)
    assert got == decontaminated(docs, items)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("block_bytes", [decontaminate.PATTERN_BYTES, 200])
def test_decontamination_of_awkward_rows(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", block_bytes)
    long = prose(1, 40)
    items = [(1, long), (2, "Übung macht den Meister"), (3, None), (4, ""), (5, "one"), (12, long.upper()), (2, "again twice"),
             (6, "a b c d e f g h i j"), (7, "tail " + long[-80:])]
    docs = [(1, None), (2, ""), (3, "..."), (4, long), (4, long), (5, "x " + long.replace(" ", ", ").upper() + " y"),
            (6, "übung macht den meister"), (None, "Übung-macht--den\nMeister; one"), (7, "a b c d e f g h i" + " j" * 30),
            (8, " ".join(prose(s, 300) for s in range(40)) + " " + long + " again twice"), (9, "again, twice" * 3)]
    frame = spark.createDataFrame(items, BENCHMARK)
    got = collected(decontaminate.decontaminate_digest(make_docs(spark, docs), frame), *COLUMNS)
    assert got == decontaminated(docs, items)
    kept = decontaminate.decontaminate(make_docs(spark, docs), frame)
    assert kept.columns == make_docs(spark, docs).columns
    assert collected(kept, "doc_id", "size") == sorted((r[0], "x") for r in decontaminated(docs, items) if not r[-1])


def test_decontamination_of_empty_tables(spark):
    docs, items = make_docs(spark, [(1, "a b c")]), spark.createDataFrame([], BENCHMARK)
    assert collected(decontaminate.decontaminate_digest(docs, items), "doc_id", "n_words", "contaminated") == [(1, 3, False)]
    assert decontaminate.decontaminate_digest(docs.limit(0), spark.createDataFrame([(1, "a")], BENCHMARK)).count() == 0


def test_toxicity_of_rows_that_did_not_train(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    found = QUERIES["op3_toxicity"](spark, sf_dir)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = wrong = 0
    for r in found.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            right, wrong = right + (r.predicted == labels[r.doc_id]), wrong + (r.predicted != labels[r.doc_id])
    assert right > 60 and wrong <= 0.04 * (right + wrong)


def planted_toxicity(spark, extra=()):
    """Half of the labelled documents hold a few of some made-up slurs, stems with varying endings among them."""
    rows, labels = [], []
    for i in range(160):
        words = prose(i, 60 + i).split()
        if i % 4 == 0:
            for at, bad in ((5, "zorg"), (9, "vlekken" if i % 8 else "vlekkast"), (14, "zorg")):
                words.insert(at, bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return make_docs(spark, [*rows, *extra]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_stems_and_reports_passages(spark):
    unseen = [(900, prose(7000, 80) + " Zorg vlekkomen " + prose(7001, 80)), (901, prose(7002, 300)), (902, None), (903, ""),
              (904, prose(7003, 6000)), (None, "zorg zorg"), (905, "zorg, zorg"), (905, "zorg, zorg")]
    docs, labels = planted_toxicity(spark, unseen)
    got = toxicity.scored(docs, toxicity.fit(docs, labels), ["doc_id", "text", "hits"])
    rows = {r.doc.doc_id: r for r in got.collect() if r.doc.doc_id is None or r.doc.doc_id >= 900}
    assert {k: r.predicted for k, r in rows.items()} == {900: 1, 901: 0, 902: 0, 903: 0, 904: 0, None: 1, 905: 1}
    first, end = rows[900].passages[0].first_byte, rows[900].passages[0].end_byte
    assert rows[900].doc.text.encode()[first:end] == b"Zorg vlekkomen"
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(160) if i % 4} | {901, 902, 903, 904}


def test_toxicity_of_many_moderate_words(spark):
    draw = random.Random(7)
    rows, labels = [], []
    for i in range(2000):
        toxic = draw.random() < 0.25
        words = draw.choices([f"word{k:03d}x" for k in range(400)], [4 if toxic and k < 40 else 1 for k in range(400)], k=150)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    found = toxicity.toxicity_digest(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = {r.doc_id: r.predicted for r in found.filter("held_out").collect()}
    toxic, clean = ([held[i] for i, t in labels if t == y and i in held] for y in (1, 0))
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_toxicity_without_labels(spark):
    docs, labels = planted_toxicity(spark)
    for none in (labels.limit(0), labels.selectExpr("doc_id", "quality", "CAST(NULL AS INT) AS toxic")):
        assert {r.predicted for r in toxicity.toxicity_digest(docs, none).collect()} == {0}
    assert toxicity.toxicity_digest(docs.limit(0), labels).count() == 0


def test_held_out_rows_do_not_train(spark):
    docs, labels = planted_toxicity(spark)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert (one.base, one.slope, one.decay) == (two.base, two.slope, two.decay)


def slow_segments(scores):
    """Maximal segments by the definition: best segment first, then both sides of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > best + 1e-9:
                best, at = total, (i, j)
    if at is None:
        return []
    return [*((i, j) for i, j in slow_segments(scores[:at[0]])), at,
            *((i + at[1], j + at[1]) for i, j in slow_segments(scores[at[1]:]))]


@pytest.mark.parametrize("seed", range(30))
def test_maximal_segments(seed):
    scores = np.random.default_rng(seed).choice([-3.0, -2.0, -1.13, 1.01, 2.07, 3.11], 24)
    assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == slow_segments(scores.tolist())


def greedy(text, vocabulary):
    most, n = max(map(len, vocabulary)), 0
    for word in (text or "").encode().split():
        word, at = b" " + word, 0
        while at < len(word):
            at += next((k for k in range(min(most, len(word) - at), 0, -1) if word[at:at + k] in vocabulary), 1)
            n += 1
    return n


def test_token_counts_equal_greedy_cutting(spark):
    vocabulary = set(token_counts.read_vocabulary())
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r.doc_id, greedy(r.text, vocabulary)) for r in docs)
    assert collected(QUERIES["op6_token_counts"](spark, SF_DIR), "doc_id", "n_tokens") == sorted(expected, key=repr)


def test_words_with_one_hash_are_counted_each(spark, monkeypatch):
    vocabulary = [b"a", b"b", b"c", b" ", b"ab", b"abc"]
    texts = ["ab abc c ab abc", "abc abc a", "b ab"]
    docs = make_docs(spark, list(enumerate(texts)), parts=1)
    want = [(i, sum(greedy(" " + w, vocabulary) for w in t.split())) for i, t in enumerate(texts)]
    rows = token_counts.token_counts(docs, ["doc_id"], vocabulary)
    assert sorted((r.doc.doc_id, r.n_tokens) for r in rows.collect()) == want
    monkeypatch.setattr(textbytes, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data, bounds = textbytes.flat(pa.array(texts))
    starts, ends, _ = textbytes.spans(data, bounds, textbytes.unspaced_bytes())
    once, which = textbytes.first_of_equals(data, starts, ends)
    words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert [words[once[i]] for i in which] == words


def test_token_counts_of_awkward_rows(spark):
    vocabulary = [b" a", b"ab", b" abc", b"abcdx", b"bcdef", b"cd", b"aa", b"aaaa", b"aaaaaaab", "é".encode(), b"", b"xyz xyz"]
    texts = [None, "", "   ", "abcdef abcdx", "aaaaaaa aaaaaaab", "é éé x", "a" * 5000 + "b", "ab" * 700 + " cd", "xyz xyz",
             "abc " * 3000]
    docs = [*enumerate(texts), (3, texts[3]), (None, "ab")]
    got = collected(token_counts.token_counts(make_docs(spark, docs), ["doc_id", "v"], vocabulary).select("doc.*", "n_tokens"),
                    "doc_id", "n_tokens")
    full = set(vocabulary) - {b""}
    assert got == sorted(((i, greedy(t, full)) for i, t in docs), key=repr)
    assert token_counts.token_counts_digest(make_docs(spark, docs).limit(0)).count() == 0


def test_licenses_in_awkward_rows(spark):
    apache, mit = license_scan.TEMPLATES[1][1], "Released under the MIT License."
    docs = [(1, None), (2, ""), (3, "a license to be silly, and nothing else at all"), (4, f"x\n{mit}\ny"), (4, f"x\n{mit}\ny"),
            (5, prose(1, 3000) + "\n" + apache.replace("compliance", "full compliance") + "\n" + prose(2, 3000) + "\n" + mit),
            (None, "This work is licensed under the GNU General Public License, version 2."), (6, "LICENSED UNDER CC BY-NC 3.0."),
            (7, "Licensed under CC BY 4.0."), (8, "all licenses " * 4000)]
    got = collected(license_scan.license_digest(make_docs(spark, docs)), "doc_id", "licenses", "n_notices", "n_differences")
    assert got == sorted([
        (1, "", 0, 0), (2, "", 0, 0), (3, "", 0, 0), (4, "MIT", 1, 0), (4, "MIT", 1, 0), (5, "Apache-2.0,MIT", 2, 1),
        (None, "GPL", 1, 1), (6, "CC-BY-NC", 1, 2), (7, "CC-BY", 1, 0), (8, "", 0, 0)], key=repr)
    assert license_scan.license_digest(make_docs(spark, docs).limit(0)).count() == 0


def licenses_in(text):
    """The licenses found in a text, in order, without Spark."""
    known, raw = license_scan.Templates(license_scan.TEMPLATES), text.encode()
    cue = license_scan.re.compile(license_scan.CUE, license_scan.re.I)
    return [m[2] for lo, hi in license_scan.blocks(raw, cue) for m in known.match(raw[lo:hi])]


@pytest.mark.parametrize("name, notice", license_scan.TEMPLATES)
def test_license_inside_a_paragraph(name, notice):
    assert licenses_in(f"{prose(1, 200)}. {notice} {prose(2, 200)}") == [name]
    assert licenses_in(f"É {prose(1, 9)}. {notice} Über {prose(2, 9)}") == [name]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("name, notice", license_scan.TEMPLATES)
def test_license_wrapped_over_lines(name, notice, mark):
    wrapped = "\n".join(mark + line for line in textwrap.wrap(notice, 72))
    assert licenses_in(f"{prose(1, 100)}\n{wrapped}\n{prose(2, 100)}") == [name]


def test_several_licenses_in_one_block():
    notices = [license_scan.TEMPLATES[i] for i in (24, 8, 0, 26, 16, 20, 3, 29)]
    assert licenses_in("Released under the MIT License. Licensed under CC BY-NC 4.0.") == ["MIT", "CC-BY-NC"]
    assert licenses_in(" ".join(text for _, text in notices)) == [name for name, _ in notices]
    assert licenses_in("Released under the MIT License.\n" * 3000) == ["MIT"] * 3000


@pytest.mark.parametrize("text", [
    "Released under the BSD License.", "Released under the ISC License.", "Licensed under the Apache License, Version 1.1.",
    "This work is licensed under a Creative Commons Attribution-NoDerivs-Zero 4.0 International License.",
    "SPDX-License-Identifier: EPL", "This work is licensed under the GNU Library General Public License, version 2.",
    "This work is licensed under the Eclipse Public License, version 2."])
def test_other_licenses_get_no_name(text):
    assert licenses_in(f"{prose(3, 40)} {text} {prose(4, 40)}") == []


@pytest.mark.parametrize("name, text", [
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General"
             " Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-SA", "This article is licensed under a Creative Commons Attribution-ShareAlike 3.0 License."),
    ("CC-BY-ND", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.")])
def test_like_wordings_keep_their_own_name(name, text):
    assert licenses_in(f"{prose(3, 40)} {text} {prose(4, 40)}") == [name]


def test_licenses_equal_a_search_of_all_templates_at_all_places():
    draw = random.Random(6)
    words = [(name, license_scan.re.findall(license_scan.WORD, text.lower())) for name, text in license_scan.TEMPLATES]
    for _ in range(40):
        said = [draw.choice([license_scan.TEMPLATES[draw.randrange(len(words))][1], prose(draw.randrange(99), draw.randrange(1, 90))])
                for _ in range(draw.randrange(1, 9))]
        text = " and then ".join(said)
        here, want, at = license_scan.re.findall(license_scan.WORD, text.lower()), [], 0
        while at < len(here):
            fit = max(((len(w), name) for name, w in words if here[at:at + len(w)] == w), default=None)
            if fit:
                want.append(fit[1])
            at += fit[0] if fit else 1
        assert licenses_in(text) == want, text


def test_compression_picks_the_candidates(monkeypatch):
    text = "Released under the MIT License."
    assert licenses_in(text) == ["MIT"]
    monkeypatch.setattr(license_scan.Templates, "taken", lambda self, i, text, size=None: (0, 1))
    known = license_scan.Templates(license_scan.TEMPLATES)
    known.own = [1] * len(known.own)
    assert known.match(text.encode()) == []


def test_licenses_in_the_documents(spark):
    names = {"Apache License": "Apache-2.0", "MIT License": "MIT", "GNU General Public": "GPL", "CC BY-NC": "CC-BY-NC"}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    expected = [(r.doc_id, ",".join(sorted(n for cue, n in names.items() if cue in r.text))) for r in docs]
    assert collected(QUERIES["op1_licenses"](spark, SF_DIR), "doc_id", "licenses") == sorted(expected, key=repr)
