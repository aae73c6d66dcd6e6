"""Quality rules from cross-document line frequency, and per-document counts.

Lines are normalised (lower-cased, white space collapsed, digit runs to 0) and hashed; a line's frequency is the number of distinct
documents (texts; copies of one text are one document) of a host that hold it. Lines of more than `least` documents are removed, on hosts of every
size alike, so a verdict does not depend on how much of a host was read. A document is rejected if it fails the base rule (fewer than 50 words, or more than
half of its words in repeated three-word windows) or if the removal depletes it: fewer than `left` of its words remain.

Defined cases: a null text is empty and fails the base rule, blank lines are no lines, a null host is the host with the empty name,
repeated rows count once for the frequencies and each get the verdict. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.llm.common import SPACE, let, stored, text_of, words_of

LEAST, LEFT, WINDOW = 10, 0.5, 3
#: Frequent lines that may be broadcast, 16 bytes each.
BROADCAST_LINES = 1_000_000
#: Frequent lines of one host that a text may be compared with in place, one after the other.
HOST_LINES = 1_000
#: A text on a host; two hashes, as copies are told apart by nothing else.
TEXT = ["host", "d1", "d2"]


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def _text_key(text: str, host: str) -> list[Column]:
    body = text_of(text)
    return [_host(host).alias("host"), F.xxhash64(body).alias("d1"), F.xxhash64(F.lit("second"), body).alias("d2")]


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of `size` words that occur twice or more, each word once.

    Most texts repeat little: a set of window hashes tells whether there is anything to find. Else the windows are sorted by
    hash, those with an equal neighbour are the repeated ones, and their positions are swept from left to right.
    """

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        many = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) >= size, many).otherwise(F.array().cast("array<bigint>"))

    def sweep(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        start = F.struct(F.lit(-size).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(size), i - acc["last"])).alias("n"))
        count = F.aggregate(let(ordered, twins), start, step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(count)

    return let(let(words, hashes), sweep).cast("long")


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """id, host, d1, d2, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed: one row per row of `docs`."""
    rows = docs.select(F.col(key).cast("long").alias("id"), *_text_key(text, host), text_of(text).alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    rows = rows.select("id", *TEXT, words_of(F.col("text")).alias("words"), lines.alias("lines"),
                       F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    rows = rows.select(
        "id", *TEXT, F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))


def _failed(words: Column, repeats: Column) -> Column:
    return (words < 50) | (repeats * 100 > words * 50)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), r"[0-9]+", "0")


def _line_words(line: Column) -> Column:
    return F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def normalised_lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """host, d1, d2, pos, line (hash), words: one row per line that is not blank."""
    rows = docs.select(*_text_key(text, host), F.posexplode(F.split(_plain(text_of(text)), "\n", -1)).alias("pos", "raw"))
    rows = rows.withColumn("raw", F.btrim("raw")).filter("raw <> ''")
    return rows.select(*TEXT, "pos", F.xxhash64("raw").alias("line"), _line_words(F.col("raw")).alias("words"))


def frequent_lines(lines: DataFrame, least: int) -> DataFrame:
    """host, line: a stored table of the lines above the limit. `lines` is a stored table."""
    frequency = lines.groupBy("host", "line").agg(F.count_distinct("d1", "d2").alias("documents"))
    return stored(frequency.filter(F.col("documents") > least).select("host", "line"), "frequent")


def removed_lines(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """host, d1, d2, removed_lines, removed_words, positions: one row per distinct text with lines above the limit."""
    # Copies repeat their lines; each position of a text counts once.
    found = lines.join(frequent, ["host", "line"]).groupBy(*TEXT, "pos").agg(F.min("words").alias("words"))
    return found.groupBy(*TEXT).agg(
        F.count("*").alias("removed_lines"), F.sum("words").alias("removed_words"), F.collect_list("pos").alias("positions")
    )


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least: int = LEAST,
             left: float = LEFT) -> DataFrame:
    """The columns of `counts` with removed_lines, removed_words and kept: one row per row of `docs`."""
    lines = stored(normalised_lines(docs, text, host), "lines")
    frequent = frequent_lines(lines, least)
    removed = stored(removed_lines(lines, frequent).drop("positions"), "removed")
    rows = counts(docs, key, text, host).join(removed, TEXT, "left").fillna(0, ["removed_lines", "removed_words"])
    depleted = F.col("n_words") - F.col("removed_words") < F.col("n_words") * F.lit(left)
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", least: int = LEAST,
          left: float = LEFT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """The rows of `docs` that are kept, without the removed lines; columns as in `docs`.

    Frequent lines are mostly few; then they are broadcast, and
    texts stay in the tasks that read them. Above `broadcast_lines`, or `HOST_LINES` of one host, each text is joined with
    its removed positions instead.
    """
    lines = stored(normalised_lines(docs, text, host), "lines")
    frequent = frequent_lines(lines, least)
    per_host = frequent.groupBy("host").count().agg(F.sum("count"), F.max("count")).first()
    if (per_host[0] or 0) <= broadcast_lines and (per_host[1] or 0) <= HOST_LINES:
        return _clean_in_place(docs, frequent, text, host, left)
    removed = stored(removed_lines(lines, frequent), "removed")
    failed = stored(
        counts(docs, key, text, host).join(removed, TEXT, "left")
        .filter(F.col("base_failed") | (F.col("n_words") - F.coalesce("removed_words", F.lit(0)) < F.col("n_words") * F.lit(left)))
        .select(*TEXT).distinct(), "failed",
    )
    names = ["__host", "__d1", "__d2"]
    mine = [c.alias(n) for c, n in zip(_text_key(text, host), names, strict=True)]
    renamed = [F.col(c).alias(n) for c, n in zip(TEXT, names, strict=True)]
    cut = removed.join(failed, TEXT, "left_anti").select(*renamed, F.col("positions").alias("__positions"))
    rows = docs.select(*docs.columns, *mine).join(failed.select(*renamed), names, "left_anti").join(cut, names, "left")
    return rows.withColumn(text, _without(text, F.col("__positions"))).select(*docs.columns)


def _without(text: str, positions: Column) -> Column:
    """The text without the lines at these positions; as it is where there are none."""

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    return F.when(F.coalesce(F.size(positions), F.lit(0)) <= 0, F.col(text)).otherwise(let(F.split(text, "\n", -1), rest))


def _clean_in_place(docs: DataFrame, frequent: DataFrame, text: str, host: str, left: float) -> DataFrame:
    by_host = frequent.groupBy(F.col("host").alias("__host")).agg(F.collect_list("line").alias("__frequent"))
    rows = docs.withColumn("__host", _host(host)).join(F.broadcast(by_host), "__host", "left")
    rows = rows.withColumn("__words", words_of(text_of(text)))
    rows = rows.withColumn("__n", F.size("__words")).filter(~_failed(F.col("__n"), repeated_words(F.col("__words"))))
    raw = F.transform(F.split(_plain(text_of(text)), "\n", -1), lambda line, i: F.struct(i.alias("pos"), F.btrim(line).alias("raw")))
    found = F.filter(raw, lambda x: (x["raw"] != "") & F.array_contains("__frequent", F.xxhash64(x["raw"])))
    rows = rows.withColumn("__found", F.when(F.col("__frequent").isNotNull(), found))
    removed = F.aggregate("__found", F.lit(0), lambda n, x: n + _line_words(x["raw"]))
    rows = rows.filter(~(F.col("__n") - F.coalesce(removed, F.lit(0)) < F.col("__n") * F.lit(left)))
    return rows.withColumn(text, _without(text, F.transform("__found", lambda x: x["pos"]))).select(*docs.columns)
