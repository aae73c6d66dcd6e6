"""Identifier masking P1-P5, entirely as Column expressions and staged projections.

A masking stage splits the text at the matches of one rule and joins the pieces with the replacements,
so numbered tokens need no Python. Each stage is its own projection: the staged text is read several
times, and Spark keeps a projection separate when inlining it would repeat the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: identifier rules in masking order (an earlier mask hides digits from later rules)
RULES = {
    "EMAIL": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "UPI": r"\b[A-Za-z0-9._\-]*[0-9.][A-Za-z0-9._\-]*@[a-z]{2,}\b",
    "PAN": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "IFSC": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "CARD": r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b",
    "AADHAAR": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
    "PHONE": r"\b(?:\+?91[\-\s]?)?[6-9]\d{9}\b",
    "ACCOUNT": r"\b\d{9,18}\b",
}
NAME_STOPWORDS = (
    "customer", "walk-in", "walk in", "walkin", "user", "the", "and", "sir",
    "madam", "none", "null", "unknown", "na", "n/a",
)
_UNICODE = "(?U)"
# Rules that need an at sign, and what any text holding one of the other identifiers contains. Masks never add
# either, so both tests look at the original text once.
_AT_RULES = ("EMAIL", "UPI")
_CODE_HINT = r"(?U)\d{4}|[A-Z]{4}0"


def _may_hold(text: Column) -> tuple[Column, Column]:
    return F.contains(text, F.lit("@")), text.rlike(_CODE_HINT)


def masked_kinds(text: Column) -> Column:
    """Every identifier becomes PII_<KIND>, without numbering."""
    body = F.coalesce(text, F.lit(""))
    at_sign, codes = _may_hold(body)

    def masked(value: Column, kinds) -> Column:
        for kind in kinds:
            value = F.regexp_replace(value, _UNICODE + RULES[kind], f"PII_{kind}")
        return value

    addresses = F.when(at_sign, masked(body, _AT_RULES)).otherwise(body)
    return F.when(codes, masked(addresses, [k for k in RULES if k not in _AT_RULES])).otherwise(addresses)


def identifier_counts(df: DataFrame, text: str, prefix: str = "n_") -> DataFrame:
    """P5: identifiers per kind, each counted on the text the earlier rules have already masked."""
    work = df.withColumn("_masked", F.coalesce(F.col(text), F.lit("")))
    at_sign, codes = _may_hold(F.col("_masked"))
    work = work.withColumns({"_at": at_sign, "_codes": codes})
    for kind, pattern in RULES.items():
        possible = F.col("_at") if kind in _AT_RULES else F.col("_codes")
        found = F.regexp_count("_masked", F.lit(_UNICODE + pattern)).cast("long")
        name = prefix + kind.lower()
        work = work.withColumn(name, F.when(possible, found).otherwise(F.lit(0).cast("long")))
        replaced = F.regexp_replace("_masked", _UNICODE + pattern, f"PII_{kind}")
        work = work.withColumn("_masked", F.when(F.col(name) > 0, replaced).otherwise(F.col("_masked")))
    return work.drop("_masked", "_at", "_codes")


def _token(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"PII_{kind}_"), number.cast("string"))


def mask_identifiers(df: DataFrame, text: str, masked: str = "masked_text", tokens: str = "pii_tokens") -> DataFrame:
    """Numbered tokens per kind in order of first appearance, and the map token -> value."""
    pair = "array<struct<token:string,value:string>>"
    work = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_pairs", F.array().cast(pair))
    at_sign, codes = _may_hold(F.col("_t"))
    work = work.withColumns({"_at": at_sign, "_codes": codes})
    for kind, pattern in RULES.items():
        rx = _UNICODE + pattern
        possible = F.col("_at") if kind in _AT_RULES else F.col("_codes")
        hits = F.regexp_extract_all("_t", F.lit(rx), F.lit(0))
        work = work.withColumn("_hits", F.when(possible, hits).otherwise(F.array().cast("array<string>")))
        work = work.withColumn("_values", F.array_distinct("_hits"))
        pieces = F.split("_t", rx, -1)
        labels = F.concat(
            F.transform("_hits", lambda v: _token(kind, F.array_position(F.col("_values"), v))),
            F.array(F.lit("")),
        )
        joined = F.array_join(F.zip_with(pieces, labels, lambda piece, label: F.concat(piece, label)), "")
        found = F.transform(
            "_values", lambda v, i: F.struct(_token(kind, i + 1).alias("token"), v.alias("value"))
        )
        any_hit = F.size("_hits") > 0
        work = work.withColumn("_t", F.when(any_hit, joined).otherwise(F.col("_t")))
        work = work.withColumn("_pairs", F.when(any_hit, F.concat("_pairs", found)).otherwise(F.col("_pairs")))
    return (
        work.withColumn(masked, F.col("_t"))
        .withColumn(tokens, F.map_from_entries("_pairs"))
        .drop("_t", "_pairs", "_hits", "_values", "_at", "_codes")
    )


def _name_candidates(name: Column) -> Column:
    """Whole name and its parts worth masking, longest first."""
    whole = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", "")
    stop = F.array(*[F.lit(w) for w in NAME_STOPWORDS])

    def keep(least: int):
        return lambda v: (F.char_length(v) >= least) & ~F.array_contains(stop, F.lower(v))

    parts = F.filter(F.split(whole, r"(?U)\s+"), keep(3))
    candidates = F.array_union(F.filter(F.array(whole), keep(2)), parts)
    longest_first = F.transform(
        candidates, lambda v: F.struct((-F.char_length(v)).alias("rank"), v.alias("value"))
    )
    return F.transform(F.array_sort(longest_first), lambda s: s["value"])


def mask_names(df: DataFrame, name: str, masked: str = "masked_text", tokens: str = "pii_tokens") -> DataFrame:
    """After the structured identifiers, mask a known name and its parts, ignoring case.

    A candidate that is itself an identifier already holds a token and takes no new number.
    """
    work = df.withColumn("_names", _name_candidates(F.col(name)))
    work = work.withColumn("_fresh", F.array_except("_names", F.map_values(tokens)))
    work = work.withColumn(
        "_entries",
        F.transform(
            "_names",
            lambda v: F.struct(
                v.alias("value"),
                F.coalesce(
                    F.element_at(F.map_from_arrays(F.map_values(tokens), F.map_keys(tokens)), v),
                    _token("NAME", F.array_position(F.col("_fresh"), v)),
                ).alias("token"),
            ),
        ),
    )
    quoted = lambda v: F.concat(
        F.lit(r"(?iU)\b\Q"), F.replace(v, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b")
    )
    work = work.withColumn(
        masked,
        F.aggregate("_entries", F.col(masked), lambda acc, e: F.regexp_replace(acc, quoted(e["value"]), e["token"])),
    )
    fresh_map = F.map_from_entries(
        F.transform(
            "_fresh",
            lambda v: F.struct(_token("NAME", F.array_position(F.col("_fresh"), v)).alias("key"), v.alias("value")),
        )
    )
    return work.withColumn(tokens, F.map_concat(tokens, fresh_map)).drop("_names", "_fresh", "_entries")


def mask(df: DataFrame, text: str, name: str | None = None, masked: str = "masked_text",
         tokens: str = "pii_tokens") -> DataFrame:
    """P2 then P3."""
    out = mask_identifiers(df, text, masked, tokens)
    return mask_names(out, name, masked, tokens) if name else out


def unmask(text: Column, tokens: Column) -> Column:
    """Put the values back; a token may come back in another case or inside square brackets."""
    ordered = F.array_sort(
        F.transform(
            F.map_entries(tokens),
            lambda e: F.struct(
                (-F.char_length(e["key"])).alias("rank"), e["key"].alias("token"), e["value"].alias("value")
            ),
        )
    )

    def literal(value: Column) -> Column:
        return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))

    def step(acc: Column, e: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iU)\[\s*"), e["token"], F.lit(r"\s*\]|"), e["token"])
        return F.regexp_replace(acc, pattern, literal(e["value"]))

    return F.aggregate(ordered, F.coalesce(text, F.lit("")), step)
