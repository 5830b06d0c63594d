"""Every operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import math
import os
import random
import re
import zlib

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pubwatch.llm import ann, bits, decontamination, jaccard, kneser_ney, language, licences, lines, mixing, textual, url_rules, warc, workload
from pubwatch.llm.storage import release
from pubwatch.session import materialize

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COMMON = "  This very line stands in MANY of the documents here, word for word.\t"


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("aeinrstlou", k=r.randint(2, 7))) for _ in range(n))


def changed(s: str, every: int) -> str:
    return " ".join(f"new{k}" if k % every == every - 1 else w for k, w in enumerate(s.split(" ")))


@pytest.fixture(scope="module")
def rows():
    base, item = text(1, 200), text(99, 30)
    many = [f"{text(10 + k, 30)}\n{COMMON if k % 2 else COMMON.strip().upper()}\nEnd {k}" for k in range(7)]
    out = [None, "", " \n\t ", "one", "One", "short text here", base, base, base.upper(), changed(base, 60), changed(base, 12), base + " " + text(3, 8)]
    out += many + [text(5, 20_000), f"{text(6, 40)} {item} {text(7, 40)}", f"{text(8, 40)} {changed(item, 8)} {text(9, 40)}", "été où ça naïve façon garçon", "12345 !!! ###", "x" * 50_000]
    table = [(k, t, ("en", "fr", None)[k % 3], ("a", "b", None, "c")[k % 4], None if t is None else len(t)) for k, t in enumerate(out)]
    return [*table, table[6], (None, base, "en", "a", 1), (None, COMMON, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(s: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (s or "").translate(LOW)) if w]


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_query_matches_sql(spark, name):
    assert compare.difference(workload.QUERIES[name](spark, FOLDER), compare.oracle(FOLDER), workload.SQL[name]) == ""


def test_mixing_of_bits():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (textual.unmix(textual.mix(x)) == x).all()


def test_words_and_slices():
    texts = ["a b", None, "", "ab\nAB  c", "é　x"]
    found = []
    for limit in (1, 1 << 20):
        got = []
        for _, offsets, data in textual.slices(pa.array(texts), limit):
            hashes, bounds = textual.words(offsets, data)
            got += [hashes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        found.append(got)
    assert found[0] == found[1] and [len(x) for x in found[0]] == [2, 0, 0, 3, 1] and found[0][3][0] == found[0][3][1]


def test_licences(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://x"
    cases = [
        (None, ""), ("", ""), ("Plain prose.", ""), ("x |\nReleased under the MIT License.", "MIT"), (apache, "Apache-2.0"),
        ("This is licensed under the GNU General Public\nLicense, version 2, or (at your option) any later version.", "GPL-2.0-or-later"),
        ("Licensed under CC BY-NC 4.0. (c) 2020 X. All rights reserved.", "CC-BY-NC-4.0,proprietary"), ("A licence of another kind.", ""),
        ("word " * 40_000 + ". Released under the MIT License. Released under the MIT License.", "MIT"),
    ]
    df = spark.createDataFrame([(k, t, "old") for k, (t, _) in enumerate(cases)], "doc_id long, text string, licences string")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    assert [got[k].licences for k in range(len(cases))] == [want for _, want in cases]
    assert got[4].n_unmatched == 0 and got[7].n_unmatched == 1
    assert licences.scan_licences(df.limit(0)).count() == 0
    plan = licences.scan_licences(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


GNU_TAIL = """
This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{1} for more details.

You should have received a copy of the GNU {1}
along with this {0}; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
"""
GNU_HEAD = """Copyright (C) 2001 A. Person

This {0} is free software; you can redistribute it and/or
modify it under the terms of the GNU {1}
as published by the Free Software Foundation{2}
"""


def test_official_licence_headers(spark):
    gnu = lambda what, name, version: GNU_HEAD.format(what, name, version) + GNU_TAIL.format(what, name)
    later = "{} version {} of the License, or (at your option)\nany later version."
    cases = [
        (gnu("program", "General Public License", later.format("; either", 2)), "GPL-2.0-or-later"),
        (gnu("program", "General Public License", "; version 2 of the License."), "GPL-2.0-only"),
        (gnu("library", "Lesser General Public\nLicense", later.format("; either", "2.1")), "LGPL-2.1-or-later"),
        (gnu("library", "Library General Public\nLicense", later.format("; either", 2)), "LGPL-2.0-or-later"),
        (gnu("program", "Lesser General Public License", later.format(", either", 3)), "LGPL-3.0-or-later"),
        (gnu("program", "General Public License", later.format(", either", 3)), "GPL-3.0-or-later"),
        (gnu("program", "Affero General Public License", later.format("; either", 3)), "AGPL-3.0-or-later"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
        ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
        ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v. 2.0 which is available at\nhttp://www.eclipse.org/legal/epl-2.0.", "EPL-2.0"),
        ("""Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement:
   This product includes software developed by the organization.
4. Neither the name of the organization nor the
   names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.
""", "BSD-4-Clause"),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    assert [got[k].licences for k in got] == [cases[k][1] for k in got] and len(got) == len(cases)
    assert "<mpl-2.0-grant><mpl-copy>" in got[7].licence_sequence and got[7].n_unmatched == 0


def test_warc(spark):
    big, other = "same " * 400, "é" * 600
    pages = [(1, "http://a/ b%20\n", big, 0), (2, None, big, 0), (9, "http://c", big, 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", other, 0), (6, "u", "small", 0), (7, "u", "small", 0), (9, "http://c", big, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    got = collections.defaultdict(list)
    for r in warc.read_archives(warc.write_archives(df)).collect():
        got[r.page_id].append(r)
    for page, url, html, _ in pages:
        data = (html or "").encode()
        r = got[page][0]
        assert (r.payload_bytes, r.payload_digest, r.url, r.error) == (len(data), hashlib.sha1(data).hexdigest(), url or "", None)
        assert (r.record_type, r.refers_to) == (("revisit", 9) if html == big and page != 9 else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else data)
    assert len(got[9]) == 2
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_frames():
    records = [warc.record_bytes(k, "u", b"x" * k, warc.base32_sha1(b"x" * k), k, None) for k in range(400)]
    archive = warc.Archive(warc.train(records))
    for r in records:
        archive.add(r)
    data = archive.out.getvalue()
    assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little") and list(warc.read_frames(io.BytesIO(data), 100)) == records
    with pytest.raises(warc.Malformed):
        list(warc.read_frames(io.BytesIO(data[:-3])))
    with pytest.raises(warc.Malformed):
        warc.parse_record(records[5].replace(b"Content-Length: 5\r\n\r\nxxxxx", b"Content-Length: 6\r\n\r\nxxxxx"))
    with pytest.raises(warc.Malformed):
        warc.parse_record(records[5][:-1])
    with pytest.raises(warc.Malformed):
        warc.parse_record(records[5].replace(b"WARC-Date", b"X-Date"))


def test_masks_find_every_window():
    import itertools

    for pair in itertools.combinations(range(decontamination.WINDOW), decontamination.SUBSTITUTIONS):
        assert any(not {s + k for k in m} & set(pair) for m in decontamination.MASKS for s in range(decontamination.WINDOW - m[-1]))


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, text(99, 30)), (2, None), (3, text(98, 30)), (4, "too short")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.overlap_words, r.equal_words, r.doc_word, r.item_word) for r in decontamination.find_overlaps(docs, items).collect())
    assert got == [(20, 1, 30, 30, 40, 0), (21, 1, 30, 27, 40, 0)]
    assert sorted(decontamination.find_overlaps(docs, items, block_bytes=100).select("doc_id").toPandas().doc_id) == [20, 21]
    kept = decontamination.decontaminate(docs, items)
    assert kept.count() == docs.count() - 2 and kept.columns == docs.columns
    assert decontamination.find_overlaps(empty, items).count() == 0 and decontamination.find_overlaps(docs, items.limit(0)).count() == 0


def test_lines(spark, docs, rows, empty):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    holders = collections.defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            holders[key(x)].add(r[0])
    want = collections.Counter()
    for r in rows:
        all_lines = (r[1] or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and r[0] != max(i for i in holders[key(x)] if i is not None))]
        want[r[0], "\n".join(kept), len(all_lines), len(all_lines) - len(kept)] += 1
    for most in (1 << 16, 1 << 6):  # a filter that is full changes nothing
        got = lines.dedup_lines(docs.withColumn("n_lines", F.lit("old")), most_bits=max(most, 1 << 17))
        assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want
    assert sum(n for (*_, n), _ in want.items()) >= 6
    assert lines.dedup_lines(empty).count() == 0


def test_filters(spark):
    df = spark.range(3000).selectExpr("xxhash64(id) AS v", "id").repartition(4)
    once, twice = (bits.filter_of_longs(df.unionAll(df.where("id < 100")), "v", twice=t) for t in (False, True))
    v = np.array([r.v for r in df.orderBy("id").collect()], dtype=np.int64).view(np.uint64)
    assert bits.contains(once, v).all() and bits.contains(twice, v[:100]).all() and bits.contains(twice, v[100:]).mean() < 0.1


def test_mixing(spark, docs, empty):
    got = mixing.mix_sources(docs, {"a": 3.0, "b": 0.0}, epochs=4.0, seed=5)
    rates = {r.source_key: r.rate for r in mixing.source_rates(docs, {"a": 3.0, "b": 0.0}, epochs=4.0).collect()}
    assert rates["sb"] == 0 and set(rates) == {"sa", "sb", "sc", "null"}
    seen = got.collect()
    assert all(r.source != "b" for r in seen) and all(1 <= r.copy <= r.n_copies for r in seen)
    again = mixing.mix_sources(docs.repartition(5), {"a": 3.0, "b": 0.0}, epochs=4.0, seed=5)
    assert collections.Counter(map(str, again.collect())) == collections.Counter(map(str, seen))
    many = spark.range(20_000).selectExpr("id AS doc_id", "'abcd' AS text", "CASE WHEN id < 200 THEN 'x' ELSE 'y' END AS source")
    counts = mixing.mix_sources(many, {}, epochs=2.0).groupBy("source").count().toPandas().set_index("source")["count"]
    assert abs(counts["x"] / 20_000 - 1) < 0.05 and abs(counts["y"] / 20_000 - 1) < 0.05
    assert mixing.mix_sources(empty, {}).count() == 0


def components(rows, n, percent):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    least = {k: min((rows[i][0] for i, x in enumerate(label) if x == k and rows[i][0] is not None), default=None) for k in label}
    return collections.Counter((r[0], len(s), least[k]) for r, s, k in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_near_duplicates(spark, rows, docs, n, percent):
    rng = random.Random(n)
    family = [(1000 + k, " ".join(f"w{rng.random()}" if rng.random() < rng.choice([0.0, 0.01, 0.02, 0.04]) else w for w in text(77, 120).split(" ")), None, None, None) for k in range(60)]
    more = docs.unionAll(spark.createDataFrame(family, DOCS))
    got = jaccard.near_duplicates(more, n=n, percent=percent)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == components([*rows, *family], n, percent)


def test_keep_one(docs, empty):
    kept = jaccard.keep_one(docs)
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[6] == 2 and not {7, 8} & set(ids) and ids[None] == 2 and kept.columns == docs.columns
    assert jaccard.near_duplicates(empty).count() == 0


def test_languages(spark, docs, empty):
    d = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = workload.QUERIES["op7_language_id"](spark, FOLDER).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == d.count() and (got.lang == got.lang_pred)[got.held_out].mean() > 0.95 and got.score.between(0, 1).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.itertuples())
    seen = language.identify_documents(docs.withColumn("score", F.lit("old"))).collect()
    assert len(seen) == docs.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in seen)
    assert language.identify_documents(empty).count() == 0 and language.identify(docs, {}).where("lang_pred <> 'und'").count() == 0
    assert {r.text for r in docs.join(language.keep_identified(docs).select("doc_id"), "doc_id", "left_anti").collect() if r.doc_id is not None} == {None, "", " \n\t ", "12345 !!! ###"}


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(8)
    finnish = "Suomen kielessä on viisitoista sijamuotoa ja sanat taipuvat niiden mukaan. Talvella järvet jäätyvät ja ihmiset kävelevät jään yli naapurikylään."
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (20, 60, 400)]
    planted = [*noise, *(base64.b64encode(rng.randbytes(n)).decode() for n in (150, 3000)), finnish, polish * 5, "x" * 5000, "Все люди рождаются свободными и равными в своём достоинстве и правах. report"]
    clean = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(10_000 + k, t, None if t[0] == "x" else ("en", None)[k % 2], "src1", len(t)) for k, t in enumerate(planted)]
    kept = {r.doc_id for r in language.keep_identified(clean.unionByName(spark.createDataFrame(rows, DOCS).select(*[F.col(f.name).cast(f.dataType) for f in clean.schema]))).collect()}
    assert kept == {r.doc_id for r in clean.collect() if any(c.isalpha() for c in r.text or "")}


def test_language_ranks_by_hand():
    c, bounds = language.padded(np.array([0, 3, 3, 8]), "ab Éa ".encode()[:8] if len("ab Éa ".encode()) >= 8 else "ab Éa x".encode())
    assert bounds[0] == 0 and c[0] == 0
    assert language.top(np.array([1, 2, 3, 4]), np.array([5, 7, 5, 1]), 3).tolist() == [2, 1, 3]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 16)).tolist()
    v[7], v[8], v[9], v[10], v[11], v[12] = v[0], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0]
    table = [(k, x) for k, x in enumerate(v)] + [(20, v[0]), (None, v[0])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(4)
    index = ann.build_index(df)
    got = collections.defaultdict(dict)
    for r in ann.nearest(index, index.where("vec_id % 50 = 0"), block=3).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    good = [(i, np.array(x)) for i, x in table if i is not None and x is not None and len(x) == 16 and x != [None] * 16 and np.isfinite(x).all() and any(x)]
    hits = 0
    for q in range(0, 400, 50):
        a = np.array(v[q])
        best = sorted((-(a @ b) / np.linalg.norm(a) / np.linalg.norm(b), i) for i, b in good if i != q)[:5]
        hits += len({i for _, i in best} & {x for x, _ in got[q].values()})
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * 40 and [got[0][k][0] for k in (1, 2)] == [7, 20] and abs(got[0][1][1] - 1) < 1e-12
    assert ann.nearest(index.limit(0), index.limit(0)).count() == 0
    assert ann.nearest(index.where("vec_id < 2"), index.where("vec_id < 2")).count() == 2


def kneser_ney_by_hand(train):
    uni, pair = collections.Counter(), collections.Counter()
    for s in train:
        w = [*words(s), "</s>"]
        uni.update(w)
        pair.update(zip(["<s>", *w[:-1]], w, strict=True))
    kinds = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
    follow = collections.Counter(b for _, b in pair)
    d2, d1 = ([0, *kneser_ney.discounts_of(*kinds(c))] for c in (pair, follow))
    total, kept = collections.Counter(), collections.Counter()
    for (a, _), c in pair.items():
        total[a] += c
        kept[a] += d2[min(c, 3)]
    all_follow = sum(follow.values())
    spare = sum(d1[min(c, 3)] for c in follow.values()) / all_follow
    alone = lambda w: max(follow[w] - d1[min(follow[w], 3)], 0) / all_follow + spare / (len(uni) + 1)
    prob = lambda a, w: max(pair[a, w] - d2[min(pair[a, w], 3)], 0) / total[a] + kept[a] / total[a] * alone(w) if total[a] else alone(w)
    return uni, prob


def test_kneser_ney(spark, docs, rows, empty):
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    uni, prob = kneser_ney_by_hand([r[1] for r in train])
    n, v = sum(uni.values()), len(uni)
    model = kneser_ney.train(docs.where(~kneser_ney.held_out()), shard_tokens=2000)
    assert model.bits > 0 and abs(sum(prob("<s>", w) for w in [*uni, "unseen"]) - 1) < 1e-9
    for r in kneser_ney.score(docs.withColumn("score", F.lit("old")), model).collect():
        w = [*words(r.text), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(uni[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(prob(a, x)) for a, x in zip(["<s>", *w[:-1]], w, strict=True)), rel_tol=1e-6)
    untrained = kneser_ney.train(empty)
    assert kneser_ney.score(empty, model).count() == 0 and kneser_ney.score(docs, untrained).where("score <> 0").count() == 0


def test_url_rules(spark):
    cases = [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme.net/", "", "", None, "allow"), ("http://A.Net/x", "a.net", "/x", "net/", "block"),
        ("http://a.net", "a.net", "", None, "allow"), ("http://x.example.net/en/?q", "x.example.net", "/en/", "example.net/en/", "allow"), ("http://example.net/en", "example.net", "/en", "net/", "block"),
        ("http://notexample.com/de/a", "notexample.com", "/de/a", None, "allow"), ("https://example.com/de/#t", "example.com", "/de/", "example.com/de/", "block"), ("ftp://o.org/fr/x?y/", "o.org", "/fr/x", "org/fr/", "allow"),
        ("http://net/", "net", "/", "net/", "block"), ("http://" + "a." * 3000 + "net/" + "p/" * 3000, "a." * 3000 + "net", "/" + "p/" * 3000, "net/", "block"),
    ]
    df = spark.createDataFrame([(k, c[0], "old") for k, c in enumerate([*cases, cases[3]])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(list(url_rules.RULES), url_rules.RULE_SCHEMA)
    got = {r.page_id: r for r in url_rules.judge_urls(df, rules).collect()}
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(cases))] == [c[1:] for c in cases] and len(got) == len(cases) + 1
    assert url_rules.judge_urls(df.limit(0), rules).count() == 0 and url_rules.judge_urls(df, rules.limit(0)).where("verdict = 'block'").count() == 0
    assert "Python" not in url_rules.judge_urls(df, rules)._jdf.queryExecution().toString()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base, item = text(1, 100), text(99, 30)
    table = [(k, t, "en", "src1", len(t)) for k, t in enumerate([base, base, changed(base, 50), f"{text(4, 30)} {item}", "123", *(text(40 + k, 60) + "\n" + COMMON for k in range(6))])]
    spark.createDataFrame(table, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
        kept.append({r.doc_id for r in docs.collect()})
    everything = set(range(len(table)))
    assert kept[:4] == [everything - {4}, everything - {4}, everything - {1, 2, 4}, everything - {1, 2, 3, 4}] and kept[4] <= kept[3]
    assert docs.where(F.col("text").contains("MANY")).select("doc_id").distinct().count() <= 1


def test_release_deletes_only_materialised_tables(spark, tmp_path):
    outside = str(tmp_path / "kept")
    spark.range(5).write.parquet(outside)
    kept, used, other = spark.read.parquet(outside), materialize(spark.range(5), "used"), materialize(spark.range(3), "other")
    folder = used.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    release(kept, used)
    assert not os.path.exists(folder)
    assert kept.count() == 5 and other.count() == 3


def test_minimum_bands():
    rng = np.random.default_rng(5)
    whole = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    bands = jaccard.minimum_bands(whole, jaccard.ANY)
    assert len(bands) == jaccard.ANY and (bands == jaccard.minimum_bands(whole.copy(), jaccard.ANY)).all()
    for size in (1, 2, 7):  # parts without a shingle take the next one's, the last ones the first
        assert len(jaccard.minimum_bands(whole[:size], jaccard.ANY)) == jaccard.ANY
    near = sum((jaccard.minimum_bands(np.delete(whole, rng.choice(len(whole), 30, replace=False)), jaccard.ANY) == bands).any() for _ in range(50))
    far = sum((jaccard.minimum_bands(np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64)), jaccard.ANY) == bands).any() for _ in range(50))
    assert near >= 48 and far == 0
