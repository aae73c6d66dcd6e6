from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from casework.llm import quality


def plain_repeats(text: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)})


def test_counts(spark):
    draw = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a a a", "a a a a", "a b c a b c", "x\x0by\x0cz", "#*$ |<>\n%&", "l\n\nl\nl ", "é ü\né ü"]
    texts += ["".join(draw.choice(["a", "b", "c", " ", " ", "\n", "#"]) for _ in range(draw.randint(0, 80))) for _ in range(150)]
    texts += [" ".join(draw.choice("abcdefghijklmnop") for _ in range(30_000))]
    docs = spark.createDataFrame([(i, t, "h", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words string")
    got = {r.id: r for r in quality.counts(docs).collect()}
    for i, text in enumerate(t or "" for t in texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), plain_repeats(text))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text[:80])
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def corpus() -> list[tuple]:
    draw = random.Random(2)
    line = lambda: " ".join(f"{draw.choice('abcdefgh')}{draw.randint(0, 10**6)}x" for _ in range(12))
    common, rare, rows = line(), line(), []
    for i in range(60):
        own = [line() for _ in range(6)]
        rows.append((i, "\n".join([common.upper() if i % 2 else f" {common}  ", *own]) if i < 40 else "\n".join(own), "hot"))
    rows += [(100 + i, "\n".join([common, *[line() for _ in range(6)]]), "small") for i in range(10)]
    rows += [(200 + i, "\n".join([rare, *[line() for _ in range(6)]]), None) for i in range(11)]
    copy = "\n".join(line() for _ in range(6))
    rows += [(300 + i, copy, "hot") for i in range(30)]
    rows += [(400, "\n".join([common] * 5 + [line()]), "hot"), (400, "\n".join([common] * 5 + [line()]), "hot")]
    return rows


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, host string")
    norm = lambda x: " ".join(re.sub("[0-9]+", "0", x.lower()).split())
    held = defaultdict(set)
    for _, text, host in rows:
        for x in text.split("\n"):
            held[host, norm(x)].add(text)
    out = {k for k, texts in held.items() if len(texts) > 10}
    assert {h for h, _ in out} == {"hot", None}
    got = quality.verdicts(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.id: r for r in got}
    for i, text, host in rows:
        gone = [x for x in text.split("\n") if (host, norm(x)) in out]
        assert by_id[i].removed_lines == len(gone) and by_id[i].removed_words == sum(len(x.split()) for x in gone)
        assert by_id[i].kept == (i != 400)
    for cleaned in (quality.clean(docs), quality.clean(docs, broadcast_lines=0)):
        assert cleaned.columns == docs.columns
        texts = defaultdict(list)
        for r in cleaned.collect():
            texts[r.doc_id].append(r.text)
        assert texts == {i: ["\n".join(x for x in text.split("\n") if (host, norm(x)) not in out)] for i, text, host in rows if i != 400}


def test_stage_limit_does_not_grow_with_the_host(spark):
    """Lines of 11 and of 190 documents go from a host of 4,000 (5 % are 200) as from a small one; a line of ten stays."""
    draw = random.Random(3)
    line = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(8)) for _ in range(12))
    many, eleven, ten, rows = line(), line(), line(), []
    for host, n in (("hot", 4000), ("small", 200)):
        for i in range(n):
            held = [many] * (i < 190) + [eleven] * (i < 11) + [ten] * (i < 10)
            rows.append((len(rows), "\n".join([*held, *[line() for _ in range(6)]]), host, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == {i: "\n".join(x for x in text.split("\n") if x not in (many, eleven)) for i, text, _, _ in rows}


def test_hosts_with_many_frequent_lines(spark, monkeypatch):
    """Both ways of cleaning give the same."""
    docs = spark.createDataFrame([(*r, "clash") for r in corpus()], "doc_id long, text string, source string, host string")
    want = sorted(map(tuple, quality.clean(docs).collect()), key=repr)
    monkeypatch.setattr(quality, "HOST_LINES", 0)
    assert sorted(map(tuple, quality.clean(docs).collect()), key=repr) == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None), (1, "", "h"), (1, "", "h")], "doc_id long, text string, source string")
    got = quality.verdicts(docs).collect()
    assert len(got) == 3 and not any(r.kept for r in got)
    assert quality.clean(docs).count() == quality.verdicts(docs.limit(0)).count() == quality.clean(docs.limit(0)).count() == 0
