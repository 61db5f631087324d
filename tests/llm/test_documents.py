"""Brute-force twins and edge cases of the operators on documents (1, 2, 4, 5, 7, 9, 10)."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from perilens.llm import decontamination, licences, registry, sentencepiece, sharding, simhash, token_counts, toxicity

DIR = "/root/testdata/sf0.001"
EDGES = [
    (1, ""), (2, None), (None, "a null id"), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "Same text here twice"), (7, "Same text here twice"),
    (7, "Same text here twice"), (8, "é中文 \U0001f600 \u0000 end"), (9, "long " * 30_000), (10, "x" * 5_000),
]
SCHEMA = "doc_id long, text string, score double, spans string, fp string, tree int, piece_ids string, bucket string, n int"


@pytest.fixture(scope="module")
def edges(spark):
    """Odd rows with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, 0.5, "s", "f", 1, "p", "b", 3) for i, t in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


# 1 ---------------------------------------------------------------------------------------------------------


def test_token_counts_follow_edits(docs):
    counter = token_counts.Counter.load(token_counts.default_vocabulary())
    edited = {}
    frame = token_counts.with_trees(docs.select("doc_id", "text")).withColumn("edits", token_counts.sample_edits(F.col("text")))
    for r in token_counts.apply_edits(frame).collect():
        assert r.n_tokens == len(counter.encoding.encode_ordinary(r.text))
        assert sum(r.tree.length) == len(r.text) and sum(r.tree.tokens) == r.n_tokens == r.tree.token_sums[1]
        edited[r.doc_id] = r.text
    assert sum(edited[r.doc_id] != r.text for r in docs.collect()) > 0.9 * len(edited)


def test_random_edits_equal_a_new_count():
    counter, rng = token_counts.Counter.load(token_counts.default_vocabulary()), random.Random(3)
    bits = ["a", " ", "  ", "\n", " \n ", "'s", "'ll", "12", "...", "é", "\t", "x y", "", " word", " ", "  "]
    for _ in range(150):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 400)))
        pieces = counter.pattern.findall(text)
        tree = token_counts.CountTree(list(map(len, pieces)), [counter[p] for p in pieces])
        for _ in range(5):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 90]))
            text, again = tree.edit(text, a, b, "".join(rng.choice(bits) for _ in range(rng.randint(0, 4))), counter)
            assert [n for leaf in tree.lengths for n in leaf] == list(map(len, counter.pattern.findall(text)))
            assert tree.total == len(counter.encoding.encode_ordinary(text))


def test_token_counts_edges(edges, empty):
    rows = token_counts.with_trees(edges)
    got = {(r.doc_id, r.text): r.n_tokens for r in rows.collect()}
    assert got[1, ""] == 0 and got[2, None] is None and got[4, "one"] == 1
    again = token_counts.apply_edits(rows.withColumn("edits", token_counts.sample_edits(F.col("text")))).collect()
    assert len(again) == len(EDGES) and next(r for r in again if r.doc_id == 2).n_tokens is None
    assert token_counts.with_trees(empty).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: list of (doc_id, fingerprint); component of each position."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        members[find(i)].append(d)
    return [min((d for d in members[find(i)] if d is not None), default=None) for i in range(len(prints))]


def check_simhash(rows, got):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = Counter((i, format(f, "016x"), c) for (i, f), c in zip(prints, brute_components(prints)))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_equals_brute_force(spark, docs):
    check_simhash([(r.doc_id, r.text) for r in docs.collect()], registry.op2_simhash(spark, DIR).collect())


def test_simhash_edges(edges, empty):
    check_simhash(EDGES, simhash.near_duplicates(edges).collect())
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_leave_no_pair_apart():
    rng = np.random.default_rng(7)
    for level in simhash.masks(2, 3):
        for _ in range(200):
            a, b = rng.choice(64, 2, replace=False).tolist()
            assert any(not m >> a & 1 and not m >> b & 1 for m in level)


@pytest.mark.parametrize("shard_rows", [16, 9])
def test_links_in_split_buckets(spark, shard_rows):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.int64)
    keys = np.unique(np.concatenate([base ^ (1 << np.int64(i)) ^ (1 << np.int64(j)) for i in range(0, 60, 7) for j in range(0, 60, 9)] + [base]))
    links = simhash.linked(spark.createDataFrame([(int(k),) for k in keys], "fp long"), 2, shard_rows=shard_rows).collect()
    parent = {int(k): int(k) for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert (r.a ^ r.b) != 0
        parent[find(r.a)] = find(r.b)
    u = keys.view(np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[:i]) <= 2):
            assert find(int(keys[i])) == find(int(keys[j]))
    assert len({find(int(k)) for k in keys}) == 12


# 4 ---------------------------------------------------------------------------------------------------------


def brute_contained(docs, items, width=5, threshold=0.8):
    out = set()
    for d, text in docs:
        words = decontamination.loose_words(text)
        for i, item in items:
            own = decontamination.shingles(decontamination.loose_words(item), width)
            if i is None or not own or not words:
                continue
            n = next(iter(own)).count(" ") + 1
            have = {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}
            if len(own & have) >= threshold * len(own):
                out.add((d, i, len(own & have), len(own)))
    return out


def test_decontamination_equals_brute_force(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in registry.op4_decontamination(spark, DIR).collect()}
    assert got == brute_contained([(r.doc_id, r.text) for r in docs.collect()], items) and got


def test_decontamination_edges_and_blocks(spark, edges, empty):
    items = [(1, "same text HERE, twice"), (2, ""), (3, None), (4, "one"), (None, "one"), (5, "long " * 8), (5, "long " * 8), (6, "a b c d e f g h i j"), (6, "same text here twice")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(EDGES, items)
    for size in (8 << 20, 20):
        got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in decontamination.contaminated(edges, table, block_bytes=size).collect()}
        assert got == want
    assert decontamination.contaminated(empty, table).count() == 0
    assert decontamination.contaminated(edges, table.limit(0)).count() == 0


def test_decontamination_with_other_white_space(spark):
    """No-break, ideographic, thin and line-separating spaces are white space in documents and items alike."""
    item = "the quick brown fox jumps over one lazy dog near a river bank today"
    spaces = ["\u00a0", "\u3000", "\u2009", "\u2028", "\u0085", "\x1f"]
    rows = [(i, "before " + s.join(item.split()) + " after") for i, s in enumerate(spaces)] + [(90, "before " + item.replace("fox ", "fox\u00a0") + " after"), (91, "none of it")]
    items = [(1, item), (2, "\u3000".join(item.split()))]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()}
    assert got == brute_contained(rows, items) and len(got) == 14


# 5 ---------------------------------------------------------------------------------------------------------


def check_shards(rows, got):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = registry.op5_sharding(spark, DIR).collect()
    check_shards(rows, got)
    moved = docs.repartition(7, "lang").select("text", "doc_id")
    assert {(r.doc_id, r.shard, r.slot) for r in sharding.shards(moved).collect()} == {(r.doc_id, r.shard, r.slot) for r in got}
    assert len({r.shard for r in got if r.row_no < 40}) == 8


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 4097])
def test_permutation_is_one_to_one(spark, n):
    rows = spark.range(n).selectExpr("id", f"bigint({n}) as total").select(sharding.permuted("id", "total", 9).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))


def test_permutation_equals_a_loop(spark):
    """The network written out with the library's hash: alternate halves, then walk until inside."""
    from math import ceil, sqrt
    from struct import pack

    def mixed(seed, i, half):
        h = 42
        for part in (pack("<i", seed), pack("<i", i), pack("<q", half)):
            h = xxhash.xxh64_intdigest(part, h)
        return h - (1 << 64) if h >> 63 else h

    for n in (7, 1000):
        a = ceil(sqrt(n))
        b = ceil(n / a)

        def place(x):
            while True:
                left, right = divmod(x, b)
                for i in range(1, 9):
                    if i % 2:
                        left = (left + mixed(20, i, right) % a) % a
                    else:
                        right = (right + mixed(20, i, left) % b) % b
                x = left * b + right
                if x < n:
                    return x

        got = spark.range(n).selectExpr("id", f"bigint({n}) as total").select("id", sharding.permuted("id", "total", 20).alias("p")).collect()
        assert {r.id: r.p for r in got} == {x: place(x) for x in range(n)}


def test_many_equal_rows_are_numbered_in_lots(spark):
    rows = spark.range(25_000).selectExpr("bigint(id div 24000) as doc_id", "'same' as text")
    got = sharding.shards(rows).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("shard", "slot").alias("places"), F.min("row_no").alias("a"), F.max("row_no").alias("b")).collect()
    assert sorted((r.n, r.places, r.b - r.a + 1) for r in got) == [(1000, 1000, 1000), (24_000, 24_000, 24_000)]


def test_sharding_edges(edges, empty):
    check_shards(EDGES, sharding.shards(edges).collect())
    assert sharding.shards(empty).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------


def test_marginals_equal_sums_over_all_label_sequences():
    rng = np.random.default_rng(2)
    trans = rng.normal(size=(2, 2))
    field = toxicity.Field({}, 0.0, trans, (1.0, 0.0), 0.1)
    lengths = [1, 7, 3, 10]
    u = rng.normal(size=sum(lengths))
    first = np.zeros(len(u), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got, at = field.marginals(u, first), 0
    for n in lengths:
        own, total, ones = u[at : at + n], 0.0, np.zeros(n)
        for k in range(1 << n):
            y = [(k >> i) & 1 for i in range(n)]
            w = np.exp(sum(own[i] for i in range(n) if y[i]) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
        assert np.allclose(got[at : at + n], ones / total)
        at += n


def test_toxic_words_are_found_and_placed(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if i % 6 == 0:
            text.insert(rng.randint(0, len(text)), rng.choice(["Grumpf,", "zorkel", "zorkly!", "zorkish"]))
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = table.select("doc_id", "toxic")
    field = toxicity.fit(table.drop("toxic"), toxicity.training(labels))
    out = toxicity.toxicity(table, field).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum((r.score >= 0.3) == bool(r.toxic) for r in held) >= 0.97 * len(held)
    spans = [r.text[s.start : s.end] for r in out for s in r.spans]
    assert spans and sum(s.strip(",!").lower() in ("grumpf", "zorkel", "zorkly", "zorkish") for s in spans) > 0.95 * len(spans)


def test_toxicity_edges(spark, edges, empty, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    field = toxicity.fit(docs, toxicity.training(labels))
    out = toxicity.toxicity(edges, field).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert toxicity.toxicity(empty, field).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.toxicity(edges, nothing).collect()} == {0.0}
    one_kind = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r.score for r in toxicity.toxicity(edges, one_kind).collect()} == {1.0}


def test_fit_on_odd_rows_and_text_ids(spark):
    rng = random.Random(3)
    rows = [(f"d{i}", " ".join(rng.choice(["tree", "house", "river", "stone"]) for _ in range(30)) + (" zorkel" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(200)]
    rows += [rows[0], rows[1], ("long", "tree house " * 150_000, 0), ("none", None, 0), ("empty", "", 0), (None, "tree", 1)]
    table = spark.createDataFrame(rows, "doc_id string, text string, toxic int")
    labels = table.select("doc_id", "toxic").union(spark.createDataFrame([("gone", 1), ("d1", None)], "doc_id string, toxic int"))
    field = toxicity.fit(table.drop("toxic"), labels)
    out = {r.doc_id: r for r in toxicity.toxicity(table, field).collect()}
    assert len(out) == 204 and all((out[f"d{i}"].score >= 0.3) == (i % 4 == 0) for i in range(200))
    assert out["long"].score < 0.3 and out["none"].score == out["empty"].score
    assert all(r.text[s.start : s.end] == "zorkel" for r in out.values() for s in r.spans)


def test_score_equals_a_plain_forward_backward(spark, docs):
    """The score of the query's field by sums over both states, one token after the other."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    field = toxicity.fit(docs, toxicity.training(labels))
    a, b = field.calibration
    for r in toxicity.toxicity(docs.limit(60), field).collect():
        u = [field.bias + sum(field.weights.get(f, 0.0) for f in toxicity.features(w)) for w in (r.text or "").split()]
        fwd, bwd = [], [(1.0, 1.0)] * len(u)
        for t, x in enumerate(u):
            before = fwd[-1] if fwd else None
            now = [sum(before[i] * np.exp(field.trans[i, y]) for i in (0, 1)) if before else 1.0 for y in (0, 1)]
            now[1] *= np.exp(x)
            fwd.append((now[0] / sum(now), now[1] / sum(now)))
        for t in range(len(u) - 2, -1, -1):
            now = [np.exp(field.trans[y, 0]) * bwd[t + 1][0] + np.exp(field.trans[y, 1] + u[t + 1]) * bwd[t + 1][1] for y in (0, 1)]
            bwd[t] = (now[0] / sum(now), now[1] / sum(now))
        clean = [f[0] * g[0] / (f[0] * g[0] + f[1] * g[1]) for f, g in zip(fwd, bwd)]
        evidence = min(30.0, max(1e-9, -sum(np.log(max(c, 1e-12)) for c in clean)))
        assert r.score == pytest.approx(1 / (1 + np.exp(-(a * np.log(np.expm1(evidence)) + b))), rel=1e-6)
        spans = [i for i, c in enumerate(clean) if 1 - c >= 0.5]
        assert [(s.start, s.end) for s in r.spans] == [m.span() for i, m in enumerate(re.finditer(r"\S+", r.text or "")) if i in spans]


def test_toxicity_query(spark, docs):
    out = registry.op7_toxicity(spark, DIR).collect()
    assert len(out) == docs.count() and all(r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(len(json.loads(r.spans)) == r.n_spans for r in out)


# 9 ---------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library_and_come_back(docs, edges, empty):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=sentencepiece.default_model())
    for frame in (docs.select("doc_id", "text"), edges):
        for r in sentencepiece.decode(sentencepiece.encode(frame)).collect():
            if r.text is None:
                assert r.piece_ids is None and r.decoded is None
            else:
                assert list(r.piece_ids) == library.encode(r.text) and r.decoded == r.text
        at_once = sentencepiece.encode(frame, decoded_col="decoded")
        assert sorted(map(str, at_once.collect())) == sorted(map(str, sentencepiece.decode(sentencepiece.encode(frame)).collect()))
    assert sentencepiece.encode(empty).count() == 0


def test_path_is_the_only_finite_one():
    """The lattice of a short segment has exactly one path whose neighbours may follow each other, and it is the result."""
    machine = sentencepiece.Transducer.load(sentencepiece.default_model())
    rng = random.Random(4)
    made = ["".join(rng.choice("▁aeinorstlmué") for _ in range(rng.randint(1, 11))) for _ in range(300)]
    for word in ("▁thereouing", "entz", "aaaa", "▁▁▁x", "naïve", *made):
        paths = [[]]
        found = []
        while paths:
            path = paths.pop()
            at = sum(len(machine.pieces[p]) for p in path)
            if at == len(word):
                found.append(path)
            for j in range(at + 1, len(word) + 1):
                p = machine.ids.get(word[at:j])
                if p in machine.alone and (not path or machine.may_follow(path[-1], p)):
                    paths.append([*path, p])
        assert len(found) == 1 and np.array(found[0], np.int32).tobytes() == machine.path(word) == machine.paths([word])[0]


# 10 --------------------------------------------------------------------------------------------------------

MIT = """// Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
// associated documentation files. The above copyright notice and this permission notice shall be included in
// all copies. The software is provided "as is", without warranty of any kind."""


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Some prose. Released under the MIT License.", ["MIT"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("# Licensed under the Apache License,\n# Version 2.0 (the \"License\");\n", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC"]),
        ("text\nReleased under the MIT License.\nmore text\nLicensed under CC BY-NC 4.0.\nend", ["MIT", "CC-BY-NC"]),
        (MIT, ["MIT"]),
        ("The permission was given. He licensed the car.", []),
        ("", []),
        (None, []),
        ("All rights reserved.", ["Proprietary"]),
    ],
)
def test_licence_rules(spark, text, want):
    row = licences.licence_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert list(row.licences) == want


FSF = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""


def test_standard_notices_are_recognised(spark):
    cases = [
        (FSF, "GPL-3.0-or-later"), (FSF.replace("\n", " "), "GPL-3.0-or-later"), (FSF.replace("version 3", "version 2").replace(",\neither", ";\neither"), "GPL-2.0-or-later"),
        (FSF.replace("GNU General", "GNU Lesser General"), "LGPL-3.0-or-later"), (FSF.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1").replace("program is free", "library is free"), "LGPL-2.1-or-later"), (FSF.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"), (APACHE, "Apache-2.0"), (APACHE.replace("\n", " "), "Apache-2.0"),
        ("Licensed under the MIT License (see LICENSE).", "MIT"), ("Released under the MIT license and maintained by us.", "MIT"),
        ("Licensed under the GNU General Public License, version 3 or later.", "GPL-3.0-or-later"), ("// SPDX-License-Identifier: MIT", "MIT"),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0-or-later"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-tag"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
        ("This software is provided 'as-is', without any express or implied\nwarranty.", "Zlib"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("made available under the terms of the Eclipse Public License 2.0 which accompanies it", "EPL-2.0"),
    ]
    out = licences.licence_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.licences) for r in out} == {i: [want] for i, (_, want) in enumerate(cases)}


def test_licence_scan_equals_a_loop(spark, docs):
    """The same tables with Python's regular expressions, over all documents."""
    got = {r.doc_id: (list(r.sentence_ids), list(r.licences)) for r in licences.licence_scan(docs).collect()}
    hint = re.compile(licences.HINT.replace("(?i)", ""), re.I)
    for r in docs.collect():
        text = re.sub(r"(?m)^[ \t]*(?:#+|/?\*+/?|//+|--)[ \t]*", "", r.text)
        text = re.sub(r"(?<=[\w,-])[ \t]*\r?\n[ \t]*(?=[a-zà-ÿ0-9]|Version|Licen[sc]e[ ,.])", " ", text)
        ids = []
        for s in re.split(r"[\r\n]+|(?<=[.!?])(?<![ ,][vV][.])[ \t]+", text):
            if hint.search(s):
                one = re.sub(r"^ +|[ .;:!?]+$", "", re.sub(r"\s+", " ", re.sub("[\"'`‘’“”]", "", s.lower())))
                ids.append(next((n for n, p in licences.SENTENCES if re.fullmatch(p, one)), "?"))
        left, found = "".join(i + "," for i in ids), []
        for name, p in licences.RULES:
            if re.search(rf"(?:^|(?<=,))(?:{p})", left):
                left = re.sub(rf"(?:^|(?<=,))(?:{p})", "", left)
                found.append(name)
        found = list(dict.fromkeys(found))
        assert got[r.doc_id] == (ids, [x for x in found if x != "Proprietary" or len(found) == 1])


BSD = """Copyright (c) 2020, The Authors.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """{}. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DAMAGES.
"""
ADVERT = """3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement: This product includes software developed by the organization.
"""
TEXTS = {
    "BSD-2-Clause": BSD + AS_IS,
    "BSD-3-Clause": BSD + ENDORSE.format(3) + AS_IS,
    "BSD-4-Clause": BSD + ADVERT + ENDORSE.format(4) + AS_IS,
    "MIT": """MIT License

Copyright (c) 2021 Someone. All rights reserved.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
   "License" shall mean the terms and conditions for use, reproduction,
   and distribution as defined by Sections 1 through 9 of this document.
   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a license.

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS.""",
    "GPL-3.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n\n    " + FSF,
    "GPL-2.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n  The licenses for most software are designed to take away your freedom.\n\n    " + FSF.replace("version 3", "version 2"),
    "LGPL-3.0-only": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.",
    "LGPL-2.1-only": "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n  The licenses for most software are designed to take away your freedom.",
    "AGPL-3.0-only": "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n  The GNU Affero General Public License is a free, copyleft license.\n\n    " + FSF.replace("GNU General", "GNU Affero General"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": 'Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION\n    OF THE PROGRAM CONSTITUTES ACCEPTANCE OF THIS AGREEMENT.',
    "EPL-1.0": 'Eclipse Public License - v 1.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").',
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.""",
    "ISC": """Copyright (c) 2004 by Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.""",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,\nEXPRESS OR IMPLIED.",
    "PostgreSQL": "Permission to use, copy, modify, and distribute this software and its\ndocumentation for any purpose, without fee, and without a written agreement\nis hereby granted, provided that the above copyright notice and this\nparagraph and the following two paragraphs appear in all copies.",
    "WTFPL": "            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\n                    Version 2, December 2004\n\n Everyone is permitted to copy and distribute verbatim or modified\n copies of this license document, and changing it is allowed as long\n as the name is changed.",
}


def test_standard_texts_give_exactly_their_licence(spark):
    cases = [(name, text) for name, text in TEXTS.items()] + [
        ("MIT", "This project is under the MIT license."), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."), ("LGPL-2.1-only", "Released under the GNU Lesser General Public License v2.1."),
        ("BSD-3-Clause", "Use is under the 3-clause BSD license."), ("Proprietary", "Copyright 2020 by nobody. All rights reserved."),
    ]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (list(r.licences), r.status) for r in licences.licence_scan(frame).collect()}
    assert got == {i: ([name], "ONE") for i, (name, _) in enumerate(cases)}
    twice = licences.licence_scan(frame.select(F.lit("a").alias("doc_id"), F.lit(TEXTS["MIT"] + "\n\n" + TEXTS["BSD-3-Clause"]).alias("text")).limit(1)).first()
    assert (list(twice.licences), twice.status) == (["BSD-3-Clause", "MIT"], "MANY")


def test_licences_that_are_denied_or_to_choose_from(spark):
    cases = [
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", ["Apache-2.0 OR MIT"]), ("Dual-licensed under the MIT license and the Apache License 2.0.", ["Apache-2.0 OR MIT"]),
        ("This code is not released under the MIT license.", []), ("The library is no longer distributed under the GNU GPL, version 2.", []), ("Not all of it is here. Released under the MIT license.", ["MIT"]),
        ("This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at:\nhttp://scripts.sil.org/OFL", ["OFL-1.1"]),
        ("The Artistic License 2.0\n\nCopyright (c) 2000-2006, The Perl Foundation.\n\nEveryone is permitted to copy and distribute verbatim copies of this license document.", ["Artistic-2.0"]),
        ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").", ["CDDL-1.0"]),
        (FSF.replace("GNU General", "GNU Library General").replace("version 3", "version 2"), ["LGPL-2.0-or-later"]), ("Licensed under MIT license or GPL version 2.", ["MIT OR GPL-2.0"]),
    ]
    out = licences.licence_scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r.doc_id: list(r.licences) for r in out} == {i: want for i, (_, want) in enumerate(cases)}


def test_long_licence_sequences_and_sentences(spark):
    """Third-party notices: very many licence sentences after a header, and one very long sentence."""
    head = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n"
    many = head + "".join(f"Part {i} of the license of things.\n" + ("A licence, GPL version 3 or later.\n" if i % 3 == 0 else "") for i in range(60_000))
    rows = [(1, many), (2, "the software was released " * 40_000 + "license"), (3, "neither the name of x " * 40_000 + "license"), (4, ("Redistribution and use. " + "the licence " * 50) * 400), (5, "released " * 20_000 + "to the CC0 license")]
    out = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert list(out[1].licences) == ["GPL-3.0-only"] and len(out[1].sentence_ids) == 80_001
    assert [list(out[i].licences) for i in (2, 3, 4, 5)] == [[], [], [], ["CC0-1.0"]]


def test_licence_edges(edges, empty):
    out = licences.licence_scan(edges).collect()
    assert len(out) == len(EDGES) and all(r.status == "NONE" for r in out)
    assert licences.licence_scan(empty).count() == 0
