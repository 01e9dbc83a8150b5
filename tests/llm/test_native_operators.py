"""Line dedup and licence scans: brute force on small tables, odd rows, and no Python in their plans."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import licences, line_dedup
from sievegrid.llm.queries import ORACLE_SQL, QUERIES


def plain_lines(rows):
    """(id, lines, removed, links, kept text) by comparing all lines."""
    lines = [(id_ is None, id_ or 0, r, n, line) for r, (id_, text) in enumerate(rows) for n, line in enumerate((text or "").split("\n"))]
    sets = {x: frozenset(x[4].encode().split()) for x in lines}
    first = {}
    for x in sorted(lines):
        if sets[x]:
            first.setdefault(sets[x], x[:4])
    links = {s: [o for o in first if o != s and 5 * len(s & o) >= 4 * len(s | o)] for s in first}
    out = []
    for r, (id_, _) in enumerate(rows):
        own = [x for x in lines if x[2] == r]
        gone = [bool(sets[x]) and (first[sets[x]] != x[:4] or any(first[o] < first[sets[x]] for o in links[sets[x]])) for x in own]
        out.append((id_, len(own), sum(gone), sum(len(links.get(sets[x], ())) for x in own), "\n".join(x[4] for x, g in zip(own, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"buckets": 8, "broadcast_rows": 0}])
def test_lines(spark, options):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 16))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(60)}"
            text.append("\t".join(words) if rng.random() < 0.3 else " ".join(words) + " ")
        rows.append((i, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "a b c d e\n\n \na b c d e"), (None, "a b c d f e"), (102, "a b c d e\n\n \na b c d e"), (103, " ".join(f"l{i}" for i in range(50_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("r"), F.lit(2).alias("k1"))
    got = line_dedup.dedup_lines(df.coalesce(1), **options).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_links, r.kept_text) for r in got), key=str) == plain_lines(rows)
    assert line_dedup.dedup_lines(df.where("false"), **options).count() == 0


def test_links_of_many_near_copies_are_counted_in_their_group(spark, monkeypatch):
    """The pairs that are formed grow with the lines of a group, not with its links; every link is counted."""
    rng = random.Random(17)
    base, rows = [f"w{i}" for i in range(60)], []
    for k in range(240):
        words = list(base)
        for at in rng.sample(range(60), rng.randrange(5)):
            words[at] = f"e{rng.randrange(40)}"
        if k % 9 == 0:
            rng.shuffle(words)
        rows.append((k, " ".join(words)))
    pairs = {}

    def counted(df, label, free=False, real=line_dedup.materialise):
        out = real(df, label, free)
        if label.startswith("line-pairs"):
            pairs[label] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialise", counted)
    want, df = plain_lines(rows), spark.createDataFrame(rows, "doc_id long, text string")
    shown = lambda found: sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_links, r.kept_text) for r in found.collect()), key=str)
    assert shown(line_dedup.dedup_lines(df)) == want
    assert sum(r[3] for r in want) > 30_000 and 0 < sum(pairs.values()) < len(rows) * 20
    assert shown(line_dedup.dedup_lines(df, block=20)) == want


PLAIN = "die der und words that say nothing at all "
TEXTS = {name: text for name, text, header in licences.templates() if not header}


def scanned(spark, rows, **options):
    df = spark.createDataFrame([(i, d, t, 1) for i, d, t in rows], "doc_id long, dir string, text string, licence int")
    return {r.doc_id: r for r in licences.scan(df, F.concat_ws("/", "dir", F.col("doc_id").cast("string")), **options).collect()}


@pytest.mark.parametrize("bound", [licences.BROADCAST_ROWS, 0])
def test_licences(spark, bound):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a", mit), (2, "a/b", "plain words " * 30), (3, "a/b/c", apache + "\nmore words here that go on for quite a while, so that this is no licence file"),
        (4, "a/b/c", "plain"), (5, "x", "plain"), (6, "a/b/c/d", apache), (7, "a/b/c/d", "plain"), (8, None, None), (9, "", ""), (7, "a/b/c/d", "plain"), (10, "ab", "plain"),
    ]
    rows += [(100 + i, f"z{i}", f"the license is under version {i} of words") for i in range(40)]
    got = scanned(spark, rows, broadcast_rows=bound)
    assert {i: got[i].licence for i in range(1, 11)} == {1: "MIT", 2: "MIT", 3: "Apache-2.0", 4: "MIT", 5: None, 6: "Apache-2.0", 7: "Apache-2.0", 8: None, 9: None, 10: None}
    assert (got[4].inherited_from, got[7].inherited_from, got[3].inherited_from) == ("a", "a/b/c/d", None)
    assert not any(got[i].own_licence for i in range(100, 140)) and not got[3].is_file and got[1].is_file


def test_whole_licence_files(spark):
    """Files with other holders' lines, in upper case or in one line, are licence files of their directories."""
    rows = [(i, f"d{i}/sub", "plain") for i in range(len(TEXTS))]
    for i, (_, text) in enumerate(sorted(TEXTS.items())):
        changed = [f"Copyright (c) 20{i:02} Some Holder, Some Other\nAll rights reserved.\n\n{text}", text.upper(), " ".join(text.split())][i % 3]
        rows.append((100 + i, f"d{i}", changed))
    got = scanned(spark, rows + [(500 + i, "e", PLAIN * 9) for i in range(30)])
    for i, name in enumerate(sorted(TEXTS)):
        assert (got[100 + i].own_licence, got[100 + i].is_file) == (name, True)
        assert (got[i].licence, got[i].inherited_from) == (name, f"d{i}")
    assert not any(got[500 + i].licence for i in range(30))


def test_wrapped_and_buried_headers(spark):
    """Headers in comments, wrapped at any width, inside a long line, or as a tag; all but the last have one."""
    headers = [h for h in licences.HEADERS if len(h[1]) > 60]
    rows, want = [], {}
    for i, (name, text) in enumerate(headers):
        words, lines = text.split(), [""]
        for w in words:
            lines = [*lines[:-1], lines[-1] + " " + w] if len(lines[-1]) < 60 else [*lines, w]
        rows.append((i, "s", PLAIN + "\n" + "\n".join(f" * {x}" for x in lines) + "\n" + (PLAIN + "\n") * 30))
        rows.append((100 + i, "s", PLAIN * 5 + ". " + text.rstrip(".") + ". " + PLAIN * 20))
        want |= {i: name, 100 + i: name}
    rows += [(300, "s", "// SPDX-License-Identifier: LGPL-2.1\nint main() {}\n" + PLAIN * 9), (301, "s", PLAIN * 50)]
    got = scanned(spark, rows)
    wrong = {i: (name, got[i].own_licence) for i, name in want.items() if got[i].own_licence != name}
    assert not wrong and got[300].own_licence == "LGPL-2.1" and got[301].own_licence is None
    assert not got[301].is_file


def test_licence_ties_and_long_texts(spark):
    both = "SPDX-License-Identifier: MIT\n" + PLAIN + "\nSPDX-License-Identifier: ISC\n" + PLAIN * 9
    long = (PLAIN * 20 + "\n") * 2_000 + "Released under the MIT License\n" + "x" * 2_000_000
    got = scanned(spark, [(1, "s", both), (2, "s", both), (3, "s", long)])
    assert (got[1].own_licence, got[2].own_licence, got[3].own_licence) == ("MIT", "MIT", "MIT")  # of equal cosines the earlier block


def test_core_terms_lose_no_template():
    texts = [text for _, text, _ in licences.templates()]
    unit = licences.vectors(texts, {t: 1.0 for v in texts for t in __import__("re").findall(licences.TERM, v.lower())})
    core = set(licences.core_terms(unit, 0.75))
    for vector in unit:
        assert sum(w * w for t, w in vector.items() if t not in core) ** 0.5 < 0.75


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_mixing", "op8_licences"])
def test_native_plans_have_no_python(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapInArrow", "CartesianProduct"))
