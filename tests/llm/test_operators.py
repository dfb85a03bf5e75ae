"""Operators against brute force, on odd rows and on the smallest tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle_compare import compare, connect
from pyspark.sql import functions as F

from assetspark.llm import license_scan, mixing, near_dedup, packing, quality_model, quality_rules, queries, repeated_spans, token_counts, url_filter
from assetspark.llm.common import lower_ascii
from assetspark.llm.exact_dedup import drop_copies, exact_groups
from assetspark.llm.mixing import mix_plan, mixed_documents, schedule

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"b{i}" for i in range(60))
ROWS = [
    (1, "Released under the MIT License.\nthe the the", "en", "a", 3),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, BASE, "en", "b", 1),
    (5, BASE.upper(), "en", "b", 1),
    (6, BASE + " tail", "en", None, 1),
    (7, LONG, "fr", "a", 9),
    (7, LONG, "fr", "a", 9),
    (None, "É ÉTÉ x", None, "c", 2),
    (9, " \n\t \x0b\x0c\r", "de", "c", 2),
    (10, LONG[:5000] + " apache license, mit license; GNU general public license version 3", "de", "a", 2),
    (11, "one two", "de", "c", 2),
    (12, "ONE two", "de", "c", 2),
]
#: Columns that the operators use inside, under other meanings.
CLASH = ["_id", "size", "kept", "n_words", "_words", "_text", "target", "length", "label", "bucket", "_rank"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", ["op2_quality_rules", "op7_exact_dedup", "op10_source_mix"])
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name]) == ""


def test_exact_groups(docs, empty):
    rows = exact_groups(docs, lower_ascii(F.coalesce("text", F.lit(""))), keep="max").collect()
    groups = defaultdict(list)
    for i, text, *_ in ROWS:
        groups[low(text)].append(i)
    want = Counter(
        (i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest())
        for i, t, *_ in ROWS
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.content_sha256) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)
    assert exact_groups(empty, F.col("text")).count() == 0
    kept = drop_copies(docs).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "2", "4", "6", "7", "7", "None", "9", "10", "11"])


def brute_components(texts, width, percent):
    sets = {}
    for i, text in texts:
        w = words(low(text))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_groups(spark, docs, empty):
    rows = near_dedup.near_groups(docs, 4).collect()
    want = brute_components([(i, t) for i, t, *_ in ROWS if i is not None], 4, 80)
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_groups(empty, 4).count() == 0
    # a chain of edits and a group just below the similarity
    rng = np.random.RandomState(4)
    made = []
    for i in range(120):
        w = [f"c{k}" for k in range(100)]
        for k in rng.choice(100, i % 7, replace=False):
            w[k] = f"e{i}x{k}"
        made.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(made, "doc_id long, text string"), 4).collect()}
    assert got == brute_components(made, 4, 80)


def test_prefix_join_loses_no_link(spark):
    rng = np.random.RandomState(8)
    sets = [(i, sorted({int(x) for x in rng.choice(60, 40, replace=False)} | {1000 + i % 5})) for i in range(60)]
    table = spark.createDataFrame(sets, "_id long, shingles array<long>")
    nodes = spark.createDataFrame([(i, i) for i, _ in sets], "rep long, component long")
    found = {(r.a, r.b) for r in near_dedup._prefix_pairs(nodes, table, 80).collect()}
    true = {(a, b) for a, x in sets for b, y in sets if a < b and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}
    assert true <= {tuple(sorted(p)) for p in found}


def test_sketch_estimates_similarity():
    rng = np.random.RandomState(1)
    pool = rng.randint(0, 1 << 62, 1000).astype(np.uint64)
    row = np.concatenate([np.zeros(900, int), np.ones(900, int), [2]])
    sketch = near_dedup.sketches(row, np.concatenate([pool[:900], pool[100:], pool[:1]]), 3, 512)
    assert (sketch != np.uint64(2**64 - 1)).all()
    assert abs((sketch[0] == sketch[1]).mean() - 0.8) < 0.08


def brute_cut(texts, length):
    seen, out = set(), {}
    for i, text in sorted(texts):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            part = raw[k : k + length]
            if part in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(part)
        left = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("length,q", [(100, 36), (24, 9)])
def test_cut_repeats(spark, docs, empty, length, q):
    rng = np.random.RandomState(length)
    passages = ["".join(rng.choice(list("abé \n"), 60)) for _ in range(6)]
    texts = [(i, "".join(passages[k] for k in rng.randint(0, 6, 8)) + "ab" * int(rng.randint(0, 90))) for i in range(40)]
    texts += [(100, None), (101, ""), (102, "a" * 500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in repeated_spans.cut_repeats(df, length, q).collect()}
    assert got == brute_cut(texts, length)
    odd = repeated_spans.cut_repeats(docs, length, q, with_text=True).collect()
    assert len(odd) == len(ROWS)
    assert length < 100 or all(r.kept_text == LONG for r in odd if r.doc_id == 7)
    assert repeated_spans.cut_repeats(empty).count() == 0


@pytest.mark.parametrize("length,q", [(100, 36), (24, 9)])
def test_cut_repeats_keeps_rows_of_one_id_apart(spark, length, q):
    rng = np.random.RandomState(2)
    fresh = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    passage = fresh(150)
    largest = np.iinfo(np.int64).max
    texts = [
        (None, fresh(300) + passage + fresh(50) + passage),  # repeats inside one null id
        (None, fresh(900)), (None, fresh(900)), (None, "short"), (None, None),  # clean ones
        (None, passage + fresh(80)), (None, passage + fresh(90)),  # the same place in two
        (5, passage + fresh(40)), (5, passage + fresh(60)), (5, fresh(500)), (largest, passage + "x"), (None, passage + "x"),
    ]
    texts += texts[5:9]  # repeated rows
    df = spark.createDataFrame(texts, "doc_id long, text string")
    keyed = {(r.doc_id, r.text): r.h for r in df.select("*", repeated_spans.text_hash(F.col("doc_id"), F.col("text")).alias("h")).collect()}
    order = sorted(keyed, key=lambda k: (k[0] is None, k[0] or 0, keyed[k]))
    want = brute_cut([(n, text) for n, (_, text) in enumerate(order)], length)
    expected = Counter((k[0], *want[order.index(k)]) for k in texts)
    got = Counter(tuple(r) for r in repeated_spans.cut_repeats(df, length, q).collect())
    assert got == expected


def test_pack(docs, empty):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 256, with_ids=True).collect()
    expected = Counter()
    for i, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 256):
            part = struct.pack(f"<{len(ids[k : k + 256])}I", *ids[k : k + 256])
            expected[i, k // 256, k, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32, bytes(r.ids)) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty, path).count() == 0


def test_pack_lengths_follow_the_method():
    rng = np.random.RandomState(3)
    for _ in range(100):
        histogram = Counter(int(x) for x in rng.randint(1, 31, rng.randint(0, 200)))
        plan, got = packing.pack_lengths(histogram, 30), Counter()
        for bins in plan:
            assert bins.gap >= 0 and sum(x * k for x, k in bins.contents) + bins.gap == 30
            assert sum(k for x, k in bins.contents if 3 * x > 30) <= 2
            for x, k in bins.contents:
                got[x] += k * bins.number
        assert got == +histogram
        # no two sequences could be one
        gaps = sorted((30 - b.gap for b in plan for _ in range(b.number)))
        assert len(gaps) < 2 or sum(gaps[:2]) > 30


def test_automaton_is_greedy_longest_match():
    rng = np.random.RandomState(5)
    for trial in range(60):
        vocabulary = {bytes(rng.choice(list(b"abc"), rng.randint(1, 5)).astype(np.uint8)) for _ in range(8)}
        texts = [bytes(rng.choice(list(b"abc"), rng.randint(1, 12)).astype(np.uint8)) for _ in range(30)]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        got = token_counts.Automaton(vocabulary).count(np.frombuffer(b"".join(texts), np.uint8), starts, ends)
        for text, n in zip(texts, got):
            at = count = 0
            while at < len(text):
                size = next((k for k in range(len(text) - at, 0, -1) if text[at : at + k] in vocabulary), 0)
                if not size:
                    count = 1
                    break
                at, count = at + size, count + 1
            assert n == count


def test_token_counts(docs, empty):
    path = queries.tokenizer_path()
    pieces = set(token_counts.byte_pieces(open(path, encoding="utf-8").read()))
    longest = max(map(len, pieces))

    def count(word):
        raw, at, n = word.encode(), 0, 0
        while at < len(raw):
            at += next(k for k in range(min(longest, len(raw) - at), 0, -1) if raw[at : at + k] in pieces)
            n += 1
        return n

    rows = token_counts.token_counts(docs, path).collect()
    want = Counter((i, len(words(t)), sum(count(w) for w in words(low(t)))) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in rows) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_string_checks_read_whole_strings():
    text = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123" + b"abcdefghijklmnopqrstuvwxyz0124" + b"abcdefghijklmnopqrstuvwxyz0123", np.uint8)
    for length in (8, 29, 30):
        one, two, three = repeated_spans.string_checks(text, np.array([0, 30, 60]), length)
        assert one == three and (one == two) == (length < 30)


def test_license_labels(docs, empty):
    rows = license_scan.license_labels(docs).collect()
    rules = license_scan.signatures()
    assert len(rows) == len(ROWS) and len(rules) > 200
    phrases = dict(license_scan.BASE)
    want = Counter()
    for i, text, *_ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        base = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        joined, found = " " + " ".join(w) + " ", []
        for r in rules:
            if r.keyword in joined:
                for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined):
                    start = joined[: m.start()].count(" ") - 1
                    found.append((start, start + m[0].count(" "), r.priority, r.label, r.confidence))
        alive = [
            a for a in found
            if not any(b[0] <= a[0] and a[1] <= b[1] and (b[2] > a[2] or (b[2] == a[2] and b[:2] != a[:2])) for b in found)
        ]
        starts = [k for k, _ in base]
        labels = {label for _, label in base} | {a[3] for a in alive}
        want[i, len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), max((a[4] for a in alive), default=0.0)] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert license_scan.license_labels(empty).count() == 0


def one_match(pattern, rng):
    """A text that the pattern matches: options and alternatives drawn."""
    pattern = pattern.replace("[0-9]{2}", "[0-9][0-9]")
    while m := re.search(r"\(\?:([^()]*)\)(\??)", pattern):
        pattern = pattern[: m.start()] + ("" if m[2] and rng.rand() < 0.5 else rng.choice(m[1].split("|"))) + pattern[m.end() :]
    pattern = re.sub(r"\[([^]]*)\]", lambda m: rng.choice(list(m[1].replace("0-9", "0123456789").replace("1-", "123").replace("0-", "012"))), pattern)
    return re.sub(r"(.)\?", lambda m: m[1] * rng.randint(0, 2), pattern)


def license_brute(text, rules):
    """Labels and score without gate and keywords."""
    joined, found = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))) + " ", []
    for r in rules:
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined):
            start = joined[: m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" "), r.priority, r.label, r.confidence))
    alive = [
        a for a in found
        if not any(b[0] <= a[0] and a[1] <= b[1] and (b[2] > a[2] or (b[2] == a[2] and b[:2] != a[:2])) for b in found)
    ]
    labels = {a[3] for a in alive} | {label for phrase, label in license_scan.BASE if f" {phrase} " in joined}
    return ",".join(sorted(labels)), max((a[4] for a in alive), default=0.0)


def test_license_gate_and_keywords_skip_no_match(spark):
    rng = np.random.RandomState(6)
    rules = license_scan.signatures()
    texts = [
        "released under GPL v2", "Licensed under GPL v2.", "gplv2", "available under Creative Commons Attribution 4.0",
        "Creative Commons BY-SA 4.0", "Creative Commons Zero", "creative commons attribution sharealike 3.0", "gpl", "commons",
    ]
    drawn = [r for r in rules if r.kind != "spdx-part"]
    assert all(any(g in r.keyword for g in license_scan.GATE) for r in rules)
    for r in drawn:
        for _ in range(3):
            text = one_match(r.pattern, rng)
            assert re.fullmatch(r.pattern, text) and r.keyword in f" {text} ", (r, text)
            texts.append(f"it is {text} today")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.license_labels(df).collect()}
    for i, text in enumerate(texts):
        want = license_brute(text, rules)
        assert want[0] or text in ("gpl", "commons"), text
        assert got[i] == want, text
    assert got[0][0] == got[1][0] == "gpl-2.0" and got[3][0] == "cc-by" and got[4][0] == "cc-by-sa"


LICENSE_TEXTS = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit-license"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("Neither the name of X nor its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "bsd-3-clause"),
    ("GPLv3 or later", "gpl-3.0-or-later"), ("GPL-3.0-only", "gpl-3.0"), ("LGPL-2.1", "lgpl-2.1"), ("AGPL-3.0", "agpl-3.0"),
    ("Apache-2.0", "apache-2.0"), ("BSD-3-Clause", "bsd-3-clause"), ("http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"),
    ("SPDX-License-Identifier: MIT", "mit-license"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "apache-2.0,mit-license"), ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache-2.0,mit-license"),
    ("CC BY-NC-SA 4.0", "cc-by-nc-sa"), ("CC BY 4.0", "cc-by"), ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc-nd"),
    ("SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note", "gpl-2.0,linux-syscall-note"), ("Apache-2.0 WITH LLVM-exception", "apache-2.0,llvm-exception"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice", "isc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("it is free to enter, as is the museum; no permission is needed", ""), ("a patent was filed and the bsd daemon smiled", ""),
]


def test_license_texts_get_their_labels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LICENSE_TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_scan.license_labels(df).collect()}
    assert [got[i] for i in range(len(LICENSE_TEXTS))] == [label for _, label in LICENSE_TEXTS]


def test_quality_rules(docs, empty):
    rows = quality_rules.quality_verdicts(docs).collect()
    assert Counter((r.doc_id, r.n_words) for r in rows) == Counter((i, len(words(t))) for i, t, *_ in ROWS)
    assert quality_rules.quality_verdicts(empty).count() == 0
    cheap, dear = quality_rules.Rule("a", F.lit(True)), quality_rules.Rule("b", F.lit(True))
    assert [r.name for r in quality_rules.order_rules([(dear, 2.0, 0.5), (cheap, 1.0, 0.5)])] == ["a", "b"]



def test_quality_selection(spark, docs, empty):
    tables = {n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels")}
    train, held = tables["labels"].filter("doc_id % 2 = 0"), tables["labels"].filter("doc_id % 2 = 1")
    rows = quality_model.quality_selection(tables["documents"], train).join(held, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.9 * len(rows)
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert {r.kept for r in quality_model.quality_selection(docs, labels).collect()} == {True}
    assert quality_model.quality_selection(empty, labels).count() == 0
    half = quality_model.quality_selection(tables["documents"], train, share=0.5).filter("kept").count()
    assert half == round(0.5 * tables["documents"].count())


def test_kth_largest(spark):
    values = [5, -7, 3, 3, 1 << 40, -(1 << 50), 0]
    df = spark.createDataFrame([(v,) for v in values], "k long")
    assert [quality_model.kth_largest(df, "k", i + 1) for i in range(7)] == sorted(values, reverse=True)


def test_mix(docs, empty):
    rows = mix_plan(docs, [5, 2, 1]).collect()
    assert len(rows) == len(ROWS)
    by_source = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_source[r.source].append(r)
    for group in by_source.values():
        assert sum(r.size for r in group) == group[0].source_size
        assert sum(r.taken for r in group) == round(group[0].target)
    assert all((r.first_slot is None) == (r.taken == 0) and (r.slots > 0) == (r.taken > 0) for r in rows)
    assert mix_plan(empty, [5, 2, 1]).count() == 0 and mixed_documents(empty, [5, 2, 1]).count() == 0


def test_mixed_documents_keep_rows_apart(spark):
    rows = [(None, f"null {i} " + "w " * (i % 7), "a") for i in range(40)] + [(i % 30, f"text {i} " + "w " * (i % 9), "ab"[i % 2]) for i in range(90)]
    clash = ["_times", "_rows", "_copy", "_row", "_slot", "_id", "slot", "rank", "size", "c0"]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("x").alias(c) for c in clash])
    got = mixed_documents(df, [5, 2, 1])
    assert got.columns == df.columns
    plan = mix_plan(df, [5, 2, 1]).collect()
    # equal counts per id and size, also where ids repeat or are null
    want = Counter()
    for r in plan:
        want[r.doc_id, r.size] += r.full_takes
    assert Counter((r.doc_id, len(words(r.text))) for r in got.collect()) == +want
    again = [(r.doc_id, r.text) for r in mixed_documents(df, [5, 2, 1]).collect()]
    assert again == [(r.doc_id, r.text) for r in got.collect()]


def test_golden_points_are_exact_beyond_four_billion_slots(spark):
    ns = [1, 2, 4_000_000_000, 3_474_000_001, (1 << 32) + 5, (1 << 40) + 12345, (1 << 43) - 1]
    got = [r.u for r in spark.createDataFrame([(n,) for n in ns], "n long").select(mixing.golden_point(F.col("n")).alias("u")).collect()]
    assert got == [n * mixing.GOLDEN % (1 << 53) for n in ns]


def test_schedule_keeps_every_prefix_near_the_shares(spark, monkeypatch):
    sizes = {1: 900, 2: 300, 3: 60, 4: 7}
    ends = np.cumsum(list(sizes.values())).tolist()
    layout = spark.createDataFrame([(nr, n, e - n, e) for (nr, n), e in zip(sizes.items(), ends)], "nr long, slots long, _from long, _to long")

    def worst():
        order = [r.nr for r in schedule(layout).orderBy("slot").collect()]
        assert Counter(order) == sizes
        seen, far = Counter(), 0.0
        for i, nr in enumerate(order, 1):
            seen[nr] += 1
            far = max(far, *(abs(seen[k] - i * n / ends[-1]) for k, n in sizes.items()))
        return far

    assert worst() < 6
    df = spark.createDataFrame([(i, "w " * 40, "ab"[i % 3 == 0]) for i in range(60)], "doc_id long, text string, source string")
    plan = lambda: sorted((r.doc_id, r.first_slot) for r in mix_plan(df, [5, 2, 1]).collect())
    before = plan()
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    assert worst() > 100 and plan() != before


def test_schedule_gives_every_source_its_slots(spark):
    slots = [2] * 10 + [3_500_000] + [2] * 9
    ends = np.cumsum(slots).tolist()
    layout = spark.createDataFrame([(i + 1, n, end - n, end) for i, (n, end) in enumerate(zip(slots, ends))], "nr long, slots long, _from long, _to long")
    per_source = schedule(layout).groupBy("nr").agg(F.count("*"), F.max("rank"), F.countDistinct("rank"), F.countDistinct("slot")).collect()
    assert sorted(map(tuple, per_source)) == [(i + 1, n, n - 1, n, n) for i, n in enumerate(slots)]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://a.COM/de/1?x#y", "x://EXAMPLE.org", "http://sub.example.org/es/2#t", "http://example.org/en/17", "https://badexample.org/es/", "http://a.net?q/de/"]
    df = spark.createDataFrame([(i, u, None if i % 2 else "<title>the tion</title>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge_urls(df.withColumn("host", F.lit("x")), queries.URL_RULES).collect()}
    assert got == {
        0: ("", "", None), 1: ("", "", None), 2: ("", "", None), 3: ("a.com", "/de/1", "com/de/"), 4: ("example.org", "", None),
        5: ("sub.example.org", "/es/2", "example.org/es/"), 6: ("example.org", "/en/17", "example.org/en/1"), 7: ("badexample.org", "/es/", "org/"),
        8: ("a.net", "", None),
    }
    assert url_filter.judge_urls(df.filter("false"), queries.URL_RULES).count() == 0
    segmenter = url_filter.Segmenter({"the": 50, "cat": 20, "sat": 20, "thecat": 1})
    assert segmenter.split("thecatsat") == ["the", "cat", "sat"] or segmenter.split("thecatsat") == ["thecat", "sat"]


def test_url_words_have_no_cap(spark):
    rng = np.random.RandomState(9)
    rare = sorted({"".join(rng.choice(list("bcdfgz"), 7)) for _ in range(21_000)})
    long = "donaudampfschifffahrtsgesellschaft"
    title = "the the " + long + " " + " ".join(rare)
    last = rare[-1]
    pages = spark.createDataFrame([(1, f"http://a.org/{last}the/{long}the/7", f"<title>{title}</title>"), (2, f"http://b.net/the{last}", None)], "page_id long, url string, html string")
    counts = {r.word: r.n for r in url_filter.word_counts(pages).collect()}
    assert counts == {"the": 2, long: 1, **dict.fromkeys(rare, 1)}
    split = spark.createDataFrame([(1, "a.org", f"/{last}the/{long}the/7", None, None), (2, "b.net", f"/the{last}", None, None)], url_filter._PAGE)
    got = {r._id: r.buckets for r in url_filter.page_buckets(split, spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    whole = url_filter.Segmenter(counts)
    assert whole.split(last + "the") == [last, "the"] and whole.split(long + "the") == [long, "the"]
    for r in split.collect():
        assert got[r._id] == [url_filter._bucket(t) for t in url_filter.tokens_of(r.host, r.path, whole)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema)
        if name == "exact_dedup":
            assert {low(r.text) for r in out.collect()} == {low(r.text) for r in docs.collect()}
            assert out.count() == len({low(r.text) for r in docs.collect()})
        if name == "near_dedup":
            comp = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in comp.items() if i == c}
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
