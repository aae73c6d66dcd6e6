"""Each stage against a brute-force version on its own input."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from casework.llm.common import table
from tests.llm.test_decontamination import plain as plain_shingles
from tests.llm.test_packing import check_laws
from tests.llm.test_quality import plain_repeats
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_spans import plain_secrets

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SMALL, "documents"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = ({r.doc_id: r for r in docs.collect()}, after.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        docs = after
    return out


def test_quality_rules(stages):
    before, after = stages["quality rules"]
    kept = {r.doc_id: r for r in after}
    assert len(kept) == len(after)
    for key, r in before.items():
        words = r.text.split()
        if len(words) < 50 or 2 * plain_repeats(r.text) > len(words):
            assert key not in kept
        elif key in kept:
            assert 2 * len(kept[key].text.split()) >= len(words) and kept[key].n_chars == len(kept[key].text)
            assert set(kept[key].text.split("\n")) <= set(r.text.split("\n"))
    assert 0 < len(kept) < len(before)


def test_near_duplicates(stages):
    before, after = stages["near-duplicates"]
    fps = {k: plain_fingerprint(r.text) for k, r in before.items()}
    roots, groups = plain_components(list(fps.values())), defaultdict(list)
    for key, fp in fps.items():
        groups[roots[fp]].append(key)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())
    assert all(before[r.doc_id] == r for r in after)


def test_decontamination(stages, spark):
    before, after = stages["benchmark decontamination"]
    items = [plain_shingles(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    clean = {k for k, r in before.items() if not any(100 * len(plain_shingles(r.text) & i) >= 80 * len(i) for i in items)}
    assert {r.doc_id for r in after} == clean and len(clean) < len(before)


def test_secrets(stages):
    before, after = stages["secret scan"]
    assert {r.doc_id for r in after} == set(before)
    changed = [r for r in after if r.text != before[r.doc_id].text]
    assert all("[" in r.text and r.n_chars == len(r.text) for r in changed)
    assert not any(plain_secrets(r.text) for r in after)
    assert {r.doc_id for r in changed} >= {k for k, r in before.items() if plain_secrets(r.text)}


def test_packing(stages):
    before, after = stages["best-fit packing"]
    check_laws(after, [(k, r.text) for k, r in before.items()])


def test_run(spark, stages):
    got = {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in stages["best-fit packing"][1]}


def test_empty(spark):
    docs = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
