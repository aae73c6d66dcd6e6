"""Text rules H1-H11 and H30-H32 as Column expressions.

Every keyword rule is a regular expression behind a literal test on the lower-cased text: a row reaches the
expression only if it contains a literal every match must contain, so most text is scanned by substring search
alone. `scan` projects the lower-cased text once for all rules of a job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.schemas import CATEGORIES, INTAKE, lookup

# --- fixed values: keyword patterns, first match wins -------------------------------------------
KEYWORD_CATEGORY = {
    "UPI": r"\bUPI\b|upi",
    "ATM": r"\bATM\b|cash.{0,15}machine",
    "Card": r"credit.?card|debit.?card|\bcard\b",
    "Loan": r"\bloan\b|EMI|home.?loan|personal.?loan",
    "NetBanking": r"net.?banking|mobile.?banking|internet.?banking",
}
WEAK_CATEGORY = {
    "UPI": r"\b(upi|paytm|gpay|google pay|phonepe|bhim)\b",
    "ATM": r"\batm\b|cash.{0,15}machine|दिखाई नहीं|कैश मशीन",
    "Card": r"credit.?card|debit.?card|\bcard\b|कार्ड",
    "Loan": r"\bloan\b|emi|home.?loan|personal.?loan|ऋण",
    "NetBanking": r"net.?banking|mobile.?banking|internet.?banking|netbanking|mobile app",
}
SUBSTRING_CATEGORY = {
    "UPI": ("upi",),
    "ATM": ("atm",),
    "Card": ("credit card", "debit card", "card"),
    "Loan": ("loan", "emi"),
    "NetBanking": ("net banking", "mobile banking", "internet banking", "netbanking"),
}
HIGH_SEVERITY = r"unauthor|fraud|stuck|debit.{0,15}fail|debited"
# Literals one of which every match of the rule contains, in lower case.
KEYWORD_LITERALS = {
    "UPI": ("upi",),
    "ATM": ("atm", "cash"),
    "Card": ("card",),
    "Loan": ("loan", "emi"),
    "NetBanking": ("banking",),
}
WEAK_LITERALS = {
    "UPI": ("upi", "paytm", "gpay", "google pay", "phonepe", "bhim"),
    "ATM": ("atm", "cash", "दिखाई नहीं", "कैश मशीन"),
    "Card": ("card", "कार्ड"),
    "Loan": ("loan", "emi", "ऋण"),
    "NetBanking": ("banking", "mobile app"),
}
HIGH_LITERALS = ("unauthor", "fraud", "stuck", "debit")
ANGRY_LITERALS = ("unacceptable", "disgust", "outrage", "terrible", "worst", "!!")
POLITE_LITERALS = ("kindly", "please", "would you", "appreciate", "sir/madam", "कृपया")
AMOUNT_LITERALS = ("rs", "₹", "inr", "rupee", "/-")
AMOUNT_NEAR = r"(?U)(?:rs\.?|₹|inr)\s*[0-9,]|[0-9,]\s*(?:rupee|/-)"
ANGRY = r"unacceptable|disgust|outrage|terrible|worst|!!"
POLITE = r"kindly|please|would you|appreciate|sir/madam|कृपया"
FRAUD_KEYWORDS = ("unauthor", "fraud", "stolen", "hack", "scam", "stuck", "debited")
CRITICAL_AMOUNT = 50000
AMOUNT_PATTERNS = (
    r"(?:Rs\.?|₹|INR)\s*([0-9,]+(?:\.[0-9]{1,2})?)",
    r"([0-9,]+(?:\.[0-9]{1,2})?)\s*(?:rupees?|/-)",
)
LANGUAGE_HINTS = (("ऀ", "hindi"), ("आहे", "marathi"), ("माझ्", "marathi"), ("ँ", "hindi"))
MARATHI_WORDS = ("आहे", "माझ्")
DEVANAGARI = "[ऀ-ॿ]"
KNOWN_CITIES = (
    "Mumbai", "Delhi", "Bengaluru", "Chennai", "Kolkata", "Hyderabad",
    "Pune", "Ahmedabad", "Jaipur", "Lucknow", "Kanpur", "Nagpur",
    "Indore", "Bhopal", "Patna", "Vadodara", "Nashik", "Aurangabad",
    "Solapur", "Thane", "Noida", "Agra", "Varanasi", "Coimbatore",
    "Gurgaon", "Rajkot", "Surat", "Vizag", "Allahabad", "Meerut",
    "Gorakhpur", "Bareilly", "Moradabad", "Aligarh", "Amravati",
    "Kolhapur", "Sangli", "Latur", "Nanded",
)

# (?i) ignore case, (?U) Unicode word boundaries and classes: the text is multilingual.
_FLAGS = "(?iU)"
# Letters that equal an ASCII letter when case is ignored but keep another lower-case form.
_ODD_CASE = ("ſ", "\u212a", "ı", "İ")


@dataclass(frozen=True)
class Scan:
    """Columns of a text under test: the text, its lower case, and whether lower case can hide a match."""

    text: Column
    lowered: Column
    odd: Column

    def has(self, *literals: str) -> Column:
        hit = self.odd
        for literal in literals:
            hit = hit | F.contains(self.lowered, F.lit(literal))
        return hit

    def matches(self, pattern: str, literals: Sequence[str]) -> Column:
        return self.has(*literals) & self.text.rlike(_FLAGS + pattern)


def scan(df: DataFrame, text: str) -> tuple[DataFrame, Scan]:
    """Add the columns `_text`, `_lowered`, `_odd`; drop them with `SCAN_COLUMNS` when the rules are applied."""
    out = df.withColumn("_text", _text(F.col(text)))
    odd = F.lit(False)
    for letter in _ODD_CASE:
        odd = odd | F.contains("_text", F.lit(letter))
    out = out.withColumns({"_lowered": F.lower("_text"), "_odd": odd})
    return out, Scan(F.col("_text"), F.col("_lowered"), F.col("_odd"))


SCAN_COLUMNS = ("_text", "_lowered", "_odd")


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _rule_chain(scanned: Scan, rules: dict[str, str], literals: dict[str, tuple], default: str) -> Column:
    chain = None
    for label, pattern in rules.items():
        hit = scanned.matches(pattern, literals[label])
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit(default))


def keyword_category(scanned: Scan) -> Column:
    """H1."""
    return _rule_chain(scanned, KEYWORD_CATEGORY, KEYWORD_LITERALS, "General")


def weak_category(scanned: Scan) -> Column:
    """H2: the wider multilingual rules that label training text."""
    return _rule_chain(scanned, WEAK_CATEGORY, WEAK_LITERALS, "General")


def substring_category(lowered: Column) -> Column:
    """H3 on an already lower-cased text."""
    chain = None
    for label, words in SUBSTRING_CATEGORY.items():
        hit = F.contains(lowered, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(lowered, F.lit(word))
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit("General"))


def severity_rule(scanned: Scan, amount: Column) -> Column:
    """H4."""
    money = F.coalesce(amount, F.lit(0.0))
    return (
        F.when(money >= CRITICAL_AMOUNT, "Critical")
        .when(scanned.matches(HIGH_SEVERITY, HIGH_LITERALS), "High")
        .when(money > 0, "Medium")
        .otherwise("Low")
    )


def sentiment_rule(scanned: Scan) -> Column:
    """H5."""
    return (
        F.when(scanned.matches(ANGRY, ANGRY_LITERALS), "Angry")
        .when(scanned.matches(POLITE, POLITE_LITERALS), "Polite")
        .when(F.contains(scanned.text, F.lit("!")) | F.contains(scanned.text, F.lit("?")), "Frustrated")
        .otherwise("Neutral")
    )


def language_tag(text: Column, mode: str = "reference") -> Column:
    """H6. `reference` keeps the single-character hints; `script` tests the whole Devanagari block."""
    body = _text(text)
    if mode == "reference":
        chain = None
        for hint, tag in LANGUAGE_HINTS:
            hit = F.contains(body, F.lit(hint))
            chain = F.when(hit, tag) if chain is None else chain.when(hit, tag)
        return chain.otherwise("english")
    if mode != "script":
        raise ValueError(f"unknown language mode: {mode}")
    marathi = F.lit(False)
    for word in MARATHI_WORDS:
        marathi = marathi | F.contains(body, F.lit(word))
    return F.when(marathi, "marathi").when(body.rlike(DEVANAGARI), "hindi").otherwise("english")


def amount_from_text(scanned: Scan) -> Column:
    """H7: the first match of each pattern; an unreadable number falls through to the next pattern.

    One pass over the lower-cased text looks for a mark beside a number; most texts with a mark's letters have none.
    """
    possible = scanned.has(*AMOUNT_LITERALS) & (scanned.odd | scanned.lowered.rlike(AMOUNT_NEAR))
    parsed = [
        F.replace(F.regexp_extract(scanned.text, _FLAGS + pattern, 1), F.lit(","), F.lit("")).try_cast("double")
        for pattern in AMOUNT_PATTERNS
    ]
    return F.when(possible, F.coalesce(*parsed))


def city_tag(lowered: Column, cities: Sequence[str] = KNOWN_CITIES) -> Column:
    """H8: the first listed city inside an already lower-cased text, else null."""
    hits = [F.when(F.contains(lowered, F.lit(city.lower())), F.lit(city)) for city in cities]
    return F.coalesce(*hits)


def canonical_label(value: Column, vocabulary: Sequence[str], default: str) -> Column:
    """H9: equal ignoring case, then contained, else the default."""
    trimmed = F.lower(F.trim(value))
    chain = F.when(value.isNull() | (value == ""), F.lit(default))
    for label in vocabulary:
        chain = chain.when(trimmed == label.lower(), F.lit(label))
    for label in vocabulary:
        chain = chain.when(F.contains(trimmed, F.lit(label.lower())), F.lit(label))
    return chain.otherwise(F.lit(default))


def text_length(text: Column) -> Column:
    """H10."""
    return F.char_length(_text(text)).cast("int")


def word_count(text: Column) -> Column:
    """Words between runs of white space."""
    return F.regexp_count(_text(text), F.lit(r"(?U)\S+")).cast("int")


def fraud_flag(lowered: Column) -> Column:
    """H11 on an already lower-cased text."""
    hit = F.contains(lowered, F.lit(FRAUD_KEYWORDS[0]))
    for word in FRAUD_KEYWORDS[1:]:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit.cast("int")


def intake_fallback(cases_columns: dict[str, Column]) -> Column:
    """The record used when no extractor ran."""
    c = cases_columns
    return F.struct(
        c["customer_name"].alias("customer_name"),
        F.substring(_text(c["complaint_text"]), 1, 140).alias("issue_summary"),
        c["account_type"].alias("account_type"),
        c["amount_involved"].alias("amount_involved"),
        F.lit(None).cast("string").alias("transaction_id"),
        c["location"].alias("location_mentioned"),
        F.array().cast("array<string>").alias("urgency_keywords"),
        F.coalesce(F.nullif(c["language"], F.lit("")), F.lit("english")).alias("detected_language"),
    )


_SCAN = "struct<open: array<int>, quoted: boolean, escaped: boolean, found: array<struct<start: int, stop: int>>>"


def balanced_objects(text: Column) -> Column:
    """Spans (start from 1, stop inclusive) between a brace and the one that closes it, outer before inner, in order of their start.

    One pass over the characters with the open braces as its state. Inside an object a double quote opens a string, in which braces are
    characters and a backslash takes the next one; a brace that nothing closes has no span.
    """
    def step(s: Column, c: Column, at: Column) -> Column:
        inside = F.size(s["open"]) > 0
        quoted = F.when(~inside, F.lit(False)).when(s["escaped"], s["quoted"]).when(c == '"', ~s["quoted"]).otherwise(s["quoted"])
        free = ~s["quoted"]
        closes = free & inside & (c == "}")
        opened = F.when(free & (c == "{"), F.concat(s["open"], F.array(at))).when(
            closes, F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        ).otherwise(s["open"])
        span = F.struct(F.element_at(s["open"], F.greatest(F.size(s["open"]), F.lit(1))).alias("start"), at.alias("stop"))
        found = F.when(closes, F.concat(s["found"], F.array(span))).otherwise(s["found"])
        escaped = s["quoted"] & ~s["escaped"] & (c == "\\")
        return F.struct(opened.alias("open"), quoted.alias("quoted"), escaped.alias("escaped"), found.alias("found")).cast(_SCAN)

    characters = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("at")))
    none = F.struct(
        F.array().cast("array<int>").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"),
        F.array().cast("array<struct<start: int, stop: int>>").alias("found"),
    ).cast(_SCAN)
    scanned = F.aggregate(characters, none, lambda s, x: step(s, x["c"], x["at"]))
    return F.array_sort(scanned["found"])


def reply_object(reply: Column) -> Column:
    """The first JSON object inside a free-form reply, as text; null when there is none.

    A reply that is JSON as a whole is taken as it is. Otherwise the first balanced object that parses is, so prose, other braces and
    further objects around it do no harm.
    """
    bare = F.trim(reply)
    unfenced = F.when(
        F.startswith(bare, F.lit("```")),
        F.trim(F.regexp_replace(F.regexp_replace(bare, r"^`+|`+$", ""), r"(?i)^json", "")),
    ).otherwise(bare)
    parts = F.transform(balanced_objects(unfenced), lambda s: F.substring(unfenced, s["start"], s["stop"] - s["start"] + 1))
    first = F.get(F.filter(parts, lambda p: F.try_parse_json(p).isNotNull()), F.lit(0))
    return F.when(F.try_parse_json(unfenced).isNotNull(), unfenced).when(F.contains(unfenced, F.lit("{")), first)


def intake_record(reply: Column) -> Column:
    """Typed record of an extractor's JSON; a bare keyword string becomes a one-item list."""
    loose = F.from_json(reply, INTAKE.simpleString().replace("array<string>", "string"))
    keywords = loose["urgency_keywords"]
    as_list = F.coalesce(
        F.from_json(keywords, "array<string>"),
        F.when(keywords.isNotNull(), F.array(keywords)),
        F.array().cast("array<string>"),
    )
    kept = F.filter(as_list, lambda k: k.isNotNull() & (k != ""))
    return F.struct(
        *[loose[f.name].alias(f.name) for f in INTAKE.fields if f.name != "urgency_keywords"],
        kept.alias("urgency_keywords"),
    )


def intake_merged(record: Column, known: dict[str, Column]) -> Column:
    """Extracted values win, known channel metadata fills what the extractor left empty."""
    def filled(name: str, source: str) -> Column:
        return F.coalesce(F.nullif(record[name], F.lit("")), F.nullif(known[source], F.lit("")), record[name])

    return F.struct(
        filled("customer_name", "customer_name").alias("customer_name"),
        record["issue_summary"].alias("issue_summary"),
        filled("account_type", "account_type").alias("account_type"),
        F.coalesce(record["amount_involved"], known["amount_involved"]).alias("amount_involved"),
        record["transaction_id"].alias("transaction_id"),
        record["location_mentioned"].alias("location_mentioned"),
        record["urgency_keywords"].alias("urgency_keywords"),
        filled("detected_language", "language").alias("detected_language"),
    )


def category_ordinal(category: Column) -> Column:
    """Position of a category in its vocabulary, for stable display orders."""
    return lookup(category, {c: i for i, c in enumerate(CATEGORIES)}, len(CATEGORIES))
