"""Operators 10, 3 and 9."""

import hashlib
import os
import re
from collections import defaultdict

import pytest
from cases import documents, empty, pairs

SF = "/root/testdata/sf0.001"


def brute_lines(rows, min_chars=20, min_docs=3):
    def line_key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))

    seen = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(line_key(x)) >= min_chars:
                seen[line_key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (d is not None and len(seen.get(line_key(x), ())) >= min_docs
                                         and d < max(seen[line_key(x)]))]
        out.append((d, len(lines), len(lines) - len(keep),
                    hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    from txgraph.llm.line_dedup import dedup_lines

    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = pairs(dedup_lines(df, digests=True, batches=batches, fanout=fanout),
                "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == brute_lines(rows)
    assert sum(x[2] for x in got) == 2
    assert dedup_lines(empty(spark), batches=batches).count() == 0
    whole = dedup_lines(df, batches=batches, whole_rows=True)
    assert whole.columns == df.columns and whole.count() == df.count()


def test_runs_merge_and_anti_join(spark):
    from txgraph.llm.line_dedup import LineRuns

    store = LineRuns(spark, fanout=2, buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, "doc bigint, h1 bigint, h2 bigint")
    store.add(batch([(1, 10, 0), (1, 11, 0), (2, 10, 0)]))
    new = store.unseen(batch([(3, 10, 0), (3, 12, 0)]))
    assert [r.h1 for r in new.collect()] == [12]
    store.add(batch([(3, 10, 0), (3, 12, 0)]))
    assert [len(x) for x in store.levels] == [0, 1]         # two runs were compacted
    store.add(batch([(4, 12, 0)]))
    assert pairs(store.repeated(2), "h1", "n_docs", "max_doc") == [(10, 3, 3), (12, 2, 4)]
    assert pairs(store.repeated(3), "h1", "n_docs", "max_doc") == [(10, 3, 3)]
    # runs hold a key once, with its first batch's counts; later ones left sightings
    rows = [r for run in store.runs() for r in run.collect()]
    assert sorted((r.h1, r.n_docs, r.max_doc) for r in rows) == [(10, 2, 2), (11, 1, 1), (12, 1, 3)]
    assert [pairs(s, "h1", "n_docs", "max_doc") for s in store.sightings] == [[(10, 1, 3)], [(12, 1, 4)]]
    plan = store._merged([n for level in store.levels for n in level])._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("Physical Plan")[-1]
    store.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def pages(spark):
    rows = [
        (1, "http://a.org/x", '<a href="http://b.com/q">b</a>'), (2, "http://b.com/q?x", None),
        (3, "HTTPS://Sub.Example.ORG/es/1#f", ""), (4, "http://example.org/en/12", "x"),
        (5, "http://n.com/de/1", '<a href="//c.net/">c</a>'), (6, "http://c.net/z", '<a href=http://n.com>n</a>'),
        (7, None, "x"), (8, "no scheme", None), (9, "http://", None), (10, "http://org/", None),
        (11, "http://xorg/", None), (11, "http://xorg/", None), (None, "http://p.com/fr/x?de", None),
    ]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr(
        "*", "'o' AS host", "1 AS trust", "'r' AS rule", "'w' AS ruled")


def test_url_filter(spark):
    from txgraph.llm.url_filter import url_filter

    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages(spark)).collect()}
    assert url_filter(pages(spark)).count() == 13
    assert got[1] == ("a.org", "/x", "org/", "allow")
    assert got[3] == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("n.com", "/de/1", "com/de/", "block")
    assert got[None] == ("p.com", "/fr/x", "com/fr/", "allow")
    # c.net links to a host with blocked pages and nobody trusted vouches for it
    assert got[6] == ("c.net", "/z", None, "block")
    # b.com is linked from an allowed host
    assert got[2] == ("b.com", "/q", None, "allow")
    for k in (7, 8, 9):
        assert got[k] == ("", "", None, "allow")
    assert got[10][2:] == ("org/", "allow") and got[11][2:] == (None, "allow")
    assert url_filter(pages(spark).limit(0)).count() == 0


def brute_ranks(edges, seeds, back, unit=100_000_000, settled=1000):
    """Ranks by plain pushing over a list of (src, dst, w); ``back``: against the links."""
    out = defaultdict(list)
    for a, b, w in edges:
        out[b if back else a].append((a if back else b, w))
    rank = {h: n * unit for h, n in seeds.items()}
    waits = dict(rank)
    while go := {h: x for h, x in waits.items() if x > rank[h] // settled}:
        waits.update(dict.fromkeys(go, 0))
        for h, x in go.items():
            for to, w in out[h]:
                m = x * w * 85 // (sum(v for _, v in out[h]) * 100)
                if m:
                    rank[to] = rank.get(to, 0) + m
                    waits[to] = waits.get(to, 0) + m
    return rank


def test_url_ranks_settle(spark):
    """Distrust reaches the end of a long chain, a loop ends, a hub's thin flow is not lost."""
    from txgraph.llm.url_filter import url_filter

    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(i, f"http://c{i}.net/", link(f"c{i + 1}.net")) for i in range(1, 14)]
    rows += [(14, "http://c14.net/", link("bad.com")), (15, "http://bad.com/de/x", link("l1.net"))]
    rows += [(20, "http://l1.net/", link("l2.net")), (21, "http://l2.net/", link("l1.net", "good.org"))]
    rows += [(30, "http://good.org/", link(*(f"n{i}.net" for i in range(3000))))]
    edges = [(f"c{i}.net", f"c{i + 1}.net", 1) for i in range(1, 14)]
    edges += [("c14.net", "bad.com", 1), ("bad.com", "l1.net", 1), ("l1.net", "l2.net", 1),
              ("l2.net", "l1.net", 1), ("l2.net", "good.org", 1)]
    edges += [("good.org", f"n{i}.net", 1) for i in range(3000)]
    rows += [(100 + i, f"http://n{i}.net/", None) for i in (0, 2999)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.host: r for r in url_filter(df).collect()}
    trust = brute_ranks(edges, {"good.org": 1}, False)
    distrust = brute_ranks(edges, {"bad.com": 1}, True)
    for h, r in got.items():
        assert (r.trust, r.distrust) == (trust.get(h, 0), distrust.get(h, 0)), h
    assert all(got[f"c{i}.net"].verdict == "block" for i in range(1, 15))
    assert got["l1.net"].verdict == "allow" and got["n2999.net"].trust > 0


def test_url_kin(spark):
    """Hosts of one site vouch for each other; strangers under one suffix do not."""
    from txgraph.llm.url_filter import url_filter

    rows = [(1, "http://bad.co.uk/", '<a href="http://worse.com/">x</a>'), (2, "http://good.co.uk/", ""),
            (3, "http://other.co.uk/", None), (4, "http://worse.com/de/", ""),
            (5, "http://www.bad.co.uk/", ""), (6, "http://a.b.bad.co.uk/", ""),
            (7, "http://x.pages.io/", '<a href="http://worse.com/">x</a>'), (8, "http://pages.io/", ""),
            (9, "http://y.pages.io/", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.host: r.verdict for r in url_filter(df).collect()}
    assert {h for h, v in got.items() if v == "block"} == {
        "bad.co.uk", "worse.com", "www.bad.co.uk", "a.b.bad.co.uk", "x.pages.io", "pages.io", "y.pages.io"}
    named = {r.host: r.verdict for r in url_filter(df, suffixes=("pages.io",)).collect()}
    assert named["x.pages.io"] == "block" and named["y.pages.io"] == named["pages.io"] == "allow"


def test_license_scan(spark):
    from txgraph.llm.licenses import license_scan

    plain = [(i, f"Ordinary line number {i} of a text about gardens and rivers\nand another one") for i in range(30)]
    rows = plain + [
        (100, "text\nReleased under the MIT License."),
        (101, "Licensed under the Apache License, Version 2.0.\nAll rights reserved."),
        (102, "She renewed her driving license last week, and the general public was happy."),
        (103, "This work is licensed under the GNU General Public License, version 3."),
        (104, None), (105, ""), (100, "text\nReleased under the MIT License."), (None, "All Rights Reserved"),
        (106, "LICENSED UNDER CC BY-NC 4.0."),
    ]
    df = documents(spark, rows)
    out = license_scan(df)
    got = {r.doc_id: (r.n_paragraphs, r.families) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[100] == (2, "MIT") and got[101] == (2, "Apache-2.0,all-rights-reserved")
    assert got[102] == (1, "") and got[103] == (1, "GPL-3.0") and got[106] == (1, "CC-BY-NC")
    assert got[104] == (0, "") and got[105] == (1, "") and got[None] == (1, "all-rights-reserved")
    assert all(got[i] == (2, "") for i in range(30))
    assert license_scan(empty(spark)).count() == 0


def test_license_scan_of_wrapped_notices(spark):
    from txgraph.llm.licenses import license_scan

    notices = {
        "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
            of this software and associated documentation files (the "Software"), to deal
            in the Software without restriction, including without limitation the rights
            to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
            copies of the Software.""",
        "BSD": """ * Redistribution and use in source and binary forms, with or without
             * modification, are permitted provided that the following conditions are met:""",
        "GPL-3.0": """# This program is free software: you can redistribute it and/or modify
            # it under the terms of the GNU General Public License as published by
            # the Free Software Foundation, either version 3 of the License, or
            # (at your option) any later version.""",
        "GPL-2.0": """This program is free software; you can redistribute it and/or modify
            it under the terms of the GNU General Public License as published by
            the Free Software Foundation; either version 2 of the License, or
            (at your option) any later version.""",
    }
    plain = [(i, f"Ordinary line number {i} of a text\nabout gardens and rivers\nand all rights of way\n"
                 "reserved for\nthe general public") for i in range(30)]
    wrapped = [(100 + i, f"A head line\r\n\n{t}\n\nand more\ntext") for i, t in enumerate(notices.values())]
    got = {r.doc_id: r for r in license_scan(documents(spark, plain + wrapped)).collect()}
    for (i, text), family in zip(wrapped, notices):
        assert family in got[i].families.split(","), (family, got[i])
        assert got[i].n_paragraphs == text.count("\n") + 1
    assert all(got[i].families == "" for i, _ in plain)


def test_license_families_against_brute_force(spark):
    """Every run of lines of notices wrapped at many widths, scored and matched in plain Python."""
    import re
    import textwrap

    import numpy as np
    from pyspark.ml.feature import HashingTF

    from txgraph.llm import licenses as L

    tail = ("as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version.")
    head = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    notices = {"GPL-3.0": f"{head}General Public License {tail}", "AGPL": f"{head}Affero General Public License {tail}",
               "LGPL": f"{head}Lesser General Public License {tail}"}
    plain = [(i, f"Line {i} of the story about gardens\nand all rights of way\nreserved for the\ngeneral public "
                 "of the works") for i in range(40)]
    wrapped = [(100 * (k + 1) + w, f"Top {w}\n" + "\n\n".join(textwrap.wrap(t, w)) + "\nend")
               for k, t in enumerate(notices.values()) for w in (12, 20, 28, 70, 1000)]
    df = documents(spark, plain + wrapped)
    got = {r.doc_id: r for r in L.license_scan(df).collect()}
    model, least = L.fit(df)
    index = HashingTF(numFeatures=L.FEATURES, binary=True).indexOf
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    split = lambda x: [w for w in re.split(r"(?:[.\-](?![0-9a-z])|[^0-9a-z.\-])+", x.lower()) if w]
    grams = lambda w: {f"{a} {b}" for a, b in zip(w, w[1:])}
    known = [(f, grams(split(t))) for f, ts in L.TEMPLATES.items() for t in ts]

    def held(w):
        return {i for i, (f, g) in enumerate(known) if len(g & grams(w)) >= 0.75 * len(g)
                and all({*w, *grams(w)} & set(t) for t in L.TELLS.get(f, ()))}

    for i, text in plain + wrapped:
        lines = [x for x in map(split, text.split("\n")) if x]
        join = lambda a, b: sum(lines[a:b], [])  # noqa: B023,E731
        units = [split(x) for x in text.split("\n")]
        units += [join(a, b) for a in range(len(lines)) for b in range(a + 2, len(lines) + 1)
                  if len(join(a, b - 1)) < L.SPAN and held(join(a, b)) - held(join(a, b - 1)) - held(join(a + 1, b))]
        said, sure = [], []
        for w in units:
            z = bias + coef[:, sorted({index(x) for x in [*w, *grams(w)]})].sum(axis=1)
            p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            f = L.FAMILIES[p.argmax()] if p.max() >= least else L.UNKNOWN
            said += [f] * (f != L.UNKNOWN)
            sure += [f] * any(known[k][0] == f for k in held(w))
        r = got[i]
        assert (r.n_paragraphs, r.n_predicted, r.n_confirmed, r.families) == (
            text.count("\n") + 1, len(said), len(sure), ",".join(sorted(set(sure)))), (text, r)
    for k, family in enumerate(notices):
        assert {got[100 * (k + 1) + w].families for w in (12, 20, 28, 70, 1000)} == {family}, family
    assert all(got[i].families == "" for i, _ in plain)


def test_licence_model_and_threshold_come_from_the_whole_corpus(spark):
    """A model of 700 documents follows those beyond the first 400 by hash, too."""
    from pyspark.sql import functions as F

    from txgraph.llm import licenses as L

    df = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("the story of the garden number "), F.col("id")).alias("text"))
    late = df.orderBy(F.xxhash64("text"), "text").collect()[400].text
    hard = [r.text for r in spark.range(4000).select(F.concat(F.lit("a license of the general public was renewed under terms about gardens and rivers number "), F.col("id")).alias(
        "text")).filter(F.xxhash64("text") > F.xxhash64(F.lit(late))).limit(200).collect()]
    more = df.unionByName(documents(spark, [(1000 + i, t) for i, t in enumerate(hard)]).select("doc_id", "text"))
    assert L.plain_features(more, "text").agg(F.sum("n")).first()[0] == 900
    a, b = (L.fit(x)[0].coefficientMatrix.toArray() for x in (df, more))
    assert abs(a - b).max() > 1e-3
    rows = spark.createDataFrame([(0.9, 3), (0.7, 2), (0.61234, 5), (0.1, 990)], "best double, n bigint")
    assert L.least_probability(rows, 0.005) == pytest.approx(0.6124)
    assert L.least_probability(rows, 0.01) == pytest.approx(0.1001)


def test_licence_words_of_long_runs_of_separators(spark):
    """A text in another script is one run of separators; so may be dots and dashes."""
    from pyspark.sql import functions as F

    from txgraph.llm import licenses as L

    texts = ["a " + "\u0436" * 300_000 + " b-", "v2.0" + ".-" * 150_000 + " c", "-.x 1.2- .3 a--b \u0436.y", "", ".-. "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.w for r in rows.select("id", L.words(F.col("text")).alias("w")).collect()}
    assert got == {0: ["a", "b"], 1: ["v2.0", "c"], 2: [".x", "1.2", ".3", "a", "-b", ".y"], 3: [], 4: []}, got


def test_licence_words_are_split_fast(spark):
    """The same words as by the plain pattern with ranges, in less than half of its time."""
    import random
    import time

    from pyspark.sql import functions as F

    from txgraph.llm import licenses as L

    def plain(t):
        return F.filter(F.split(t, r"(?:[^0-9a-z.\-]++|[.\-](?![0-9a-z]))++"), lambda w: w != "")

    def seconds(f):
        times = []
        for _ in range(4):
            start = time.perf_counter()
            rows.select(f(F.col("text")).alias("w")).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times)

    rnd = random.Random(3)
    odd = ["".join(rnd.choices("ab09zZ.-- \n\t_\u00e9\u0436\U0001f600", k=rnd.randrange(30))) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    assert df.filter(~(L.words(F.col("text")) == plain(F.col("text")))).count() == 0
    rows = spark.range(0, 400, 1, 4).select(F.repeat(F.concat(
        F.lit("words of gardens, rivers and version 2.0 - of all "), F.col("id")), 200).alias("text")).localCheckpoint()
    assert seconds(L.words) < 0.5 * seconds(plain)


def test_licence_model_has_only_columns_that_can_be_set(spark):
    """The optimiser's arrays on the driver are as wide as the known texts' grams, not as the hash space."""
    from pyspark.ml.feature import HashingTF

    from txgraph.llm import licenses as L

    model, _ = L.fit(documents(spark, [(i, f"the story of the garden number {i}") for i in range(50)]))
    index = HashingTF(numFeatures=L.FEATURES).indexOf
    used = sorted({index(g) for g in L.vocabulary()})
    assert model.fitted.numFeatures == len(used) <= len(L.vocabulary())
    wide = model.coefficientMatrix.toArray()
    assert wide.shape == (len(L.FAMILIES), L.FEATURES)
    assert (wide[:, used] == model.fitted.coefficientMatrix.toArray()).all()
    assert (wide != 0).any(axis=0).nonzero()[0].tolist() == used


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", ["op3_url_filter", "op4_topk", "op10_line_dedup", "op11_decontaminate"])
def test_sql(spark, name):
    import duckdb

    from txgraph.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, res.fetchall()))
