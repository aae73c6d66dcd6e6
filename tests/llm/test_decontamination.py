from __future__ import annotations

import random

import pytest

from casework.llm import decontamination

DOCS, ITEMS = "doc_id long, text string, item string", "item_id long, text string, need string"


def plain_words(text: str | None) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def plain(text: str | None, width: int = 5) -> set:
    words = plain_words(text)
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_equals_brute_force(spark, block):
    draw = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, passage(draw.choice([1, 3, 5, 7, 9, 20, 40, 64, 130]))) for i in range(60)]
    docs = []
    for d in range(150):
        words = passage(draw.randint(0, 400))
        for _, item in draw.sample(items, 2):
            item = [w if draw.random() > 0.04 else "changed" for w in item]
            at = draw.randint(0, len(words))
            words[at:at] = item
        docs.append((d, ", ".join(words).upper()))
    docs += [(1000 + i, " ".join(words)) for i, words in items]
    items = [(i, " ".join(words)) for i, words in items]
    want = set()
    for d, text in docs:
        for i, item in items:
            width = min(5, len(plain_words(item)))
            mine, theirs = plain(text, width), plain(item, width)
            if 100 * len(mine & theirs) >= 80 * len(theirs):
                want.add((d, i, len(mine & theirs), len(theirs)))
    found = decontamination.contained(
        spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS), block=block
    )
    assert {(r.doc, r.item, r.shared, r.item_shingles) for r in found.collect()} == want and len(want) > 100


def test_odd_rows(spark):
    item = "one two three four five six seven"
    docs = [(1, None, "x"), (2, "", "x"), (3, f"zero {item} eight", "x"), (3, f"zero {item} eight", "x"), (3, item + " nine", "y"), (None, item, "z"),
            (5, "short one", "x"), (6, "a short one", "x"), (7, "w " * 200_000 + item, "x")]
    items = [(10, item, "x"), (10, item, "x"), (11, item, "x"), (12, None, "x"), (13, "Short, one!", "x"), (None, item, "x")]
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = sorted(((r.doc, r.item, r.containment) for r in decontamination.contained(docs, items).collect()), key=repr)
    assert found == sorted([(d, i, 1.0) for d in (3, None, 7) for i in (10, 11, None)] + [(5, 13, 1.0), (6, 13, 1.0)], key=repr)
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert decontamination.contained(docs.limit(0), items).count() == decontamination.contained(docs, items.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, items.limit(0)).count() == docs.count()
