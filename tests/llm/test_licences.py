"""Licences against a plain TF-IDF over the same terms."""

from __future__ import annotations

import math
import re
from collections import Counter

from casework.llm import licences, queries

SMALL = "/root/testdata/sf0.01"

FILES = "doc_id long, path string, text string, licence string"


def plain_terms(text: str) -> list[str]:
    return [t for t in re.sub(r"[^\w.]+|_", " ", re.sub(r"\.(?![0-9])", " ", text.lower())).split(" ") if t]


def plain_own(rows: list[tuple], least: float = licences.LEAST) -> dict:
    df = Counter(t for r in rows for t in set(plain_terms(r[2] or "")))

    def vector(text: str) -> dict:
        return {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in Counter(plain_terms(text)).items()}

    def cosine(a: dict, b: dict) -> float:
        norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(t, 0) for t, x in a.items()) / norm if norm else 0.0

    templates = [(name, vector(text)) for name, text in licences.TEMPLATES]
    out = {}
    for key, path, text, *_ in rows:
        parts = re.split(r"\n|(?<=[.!?;])\s", text or "")
        parts = [p for p in parts if re.search(licences.CUE, p)]
        if parts and path and re.search(licences.LICENCE_FILE, path):
            parts.append(text)
        scores = [(-round(cosine(vector(p), v), 9), name) for p in parts for name, v in templates]
        best = min((s for s in scores if -s[0] >= least), default=None)
        if best:
            out[key, path] = (best[1], -best[0])
    return out


def test_templates_and_inheritance(spark):
    apache, mit, gpl = (dict(licences.TEMPLATES)[n] for n in ("Apache-2.0", "MIT", "GPL-3.0"))
    long = "lorem ipsum dolor\n" * 30_000 + "Released under the MIT license.\n" + "more words " * 1000
    rows = [
        (1, "LICENSE", f"Some project\n{apache}"), (2, "a/x.py", "plain text about a license of no kind"), (3, "a/b/COPYING.txt", gpl), (4, "a/b/c/y.py", None),
        (5, "a/b/c/z.py", "code. Released under the MIT License. more"), (6, "a/bc/w.py", ""), (7, None, mit), (8, None, "x"), (9, "a/b/c/y.py", long),
        (10, "q/LICENSE", "nothing stated here but license"), (10, "q/LICENSE", "nothing stated here but license"), (None, "q/r/s.txt", "Licensed under CC BY-NC 4.0."),
        (12, "a/b/LICENSE", "Licensed under CC BY 4.0."),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], FILES)
    got = licences.scan(files).collect()
    assert len(got) == len(rows)
    want = plain_own(rows)
    assert {(r.id, r.path): (r.own_licence, round(r.cosine, 6)) for r in got if r.own_licence} == {k: (n, round(c, 6)) for k, (n, c) in want.items()}
    assert {n for n, _ in want.values()} == {"Apache-2.0", "GPL-3.0", "MIT", "CC-BY-NC-4.0", "CC-BY-4.0"}
    result = {(r.id, r.path): (r.licence, r.inherited_from) for r in got}
    assert result[2, "a/x.py"] == result[6, "a/bc/w.py"] == result[10, "q/LICENSE"] == ("Apache-2.0", "")
    assert result[4, "a/b/c/y.py"] == ("GPL-3.0", "a/b")
    assert result[5, "a/b/c/z.py"] == result[9, "a/b/c/y.py"] == ("MIT", None)
    assert result[7, None] == ("MIT", None) and result[8, None] == (None, None)
    assert licences.scan(files.limit(0)).count() == 0


def test_words_outside_the_templates_count(spark):
    said = {
        1: ("He was released yesterday under a fishing license scheme that most villagers had long forgotten.", None),
        2: ("GNU Affero General Public License, version 3", "AGPL-3.0"),
        3: ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        4: ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        5: ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
        6: ("Released under the MIT License.", "MIT"),
    }
    texts = [(r.doc_id, f"d/{r.doc_id}", r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [(-k, f"s/{k}", text) for k, (text, _) in said.items()] + texts
    got = {r.id: r.licence for r in licences.own_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {k: got.get(-k) for k in said} == {k: name for k, (_, name) in said.items()}


def test_query_equals_plain_scan(spark):
    files = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", f"{queries.DOC_PATH} AS path", "text")
    rows = [tuple(r) for r in files.collect()]
    want = plain_own(rows)
    got = queries.op1(spark, SMALL).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.path): (r.own_licence, round(r.cosine, 6)) for r in got if r.own_licence} == {k: (n, round(c, 6)) for k, (n, c) in want.items()}
    named: dict = {}
    for (key, path), (licence, _) in want.items():
        if re.search(licences.LICENCE_FILE, path):
            folder = path.rpartition("/")[0]
            named[folder] = min(named.get(folder, (path, key, licence)), (path, key, licence))
    for r in got:
        above = r.path.rpartition("/")[0].split("/")
        chain = ["/".join(above[:n]) for n in range(len(above), -1, -1)]
        given = next((named[f][2] for f in chain if f in named), None)
        assert r.licence == (r.own_licence or given), r.path


def test_equal_cosines_take_the_first_licence(spark):
    tie = "Licensed under the BSD Clause License."
    rows = [(1, "a/x", tie), (2, "a/y", tie), (3, "a/z", None)]
    got = {r.id: r.licence for r in licences.own_licences(spark.createDataFrame(rows, "doc_id long, path string, text string"), least=0.1).collect()}
    assert got == {k: plain_own(rows, 0.1)[k, p][0] for k, p, text in rows if text}
