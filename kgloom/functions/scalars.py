"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical predicates: fixed values.
PREDICATES = {
    "issued": "ISSUED_BY", "created_bill": "ISSUED_BY", "generated_invoice": "ISSUED_BY", "purchased": "PURCHASED", "bought": "PURCHASED", "ordered": "PURCHASED",
    "supplied_by": "SUPPLIED_BY", "provided_by": "SUPPLIED_BY", "contains": "CONTAINS_PRODUCT", "includes": "CONTAINS_PRODUCT", "belongs_to": "BELONGS_TO",
    "located_in": "LOCATED_IN", "has_amount": "HAS_AMOUNT", "has_date": "HAS_DATE", "references": "REFERENCES", "derived_from": "DERIVED_FROM",
}

#: Groups of entity types: fixed values.
ENTITY_GROUPS = {
    "vehicle_details": ["vin", "engine_number", "registration_number", "chassis_number", "make", "model", "variant", "color", "fuel_type"],
    "customer_details": ["customer_name", "gstin", "address", "phone", "email", "pan", "state", "state_code"],
    "delivery_details": ["delivery_address", "delivery_gstin", "delivery_state", "place_of_supply", "ship_to_name"],
    "invoice_details": ["invoice_number", "po_number", "invoice_date", "total_amount", "tax_amount", "cgst", "sgst", "igst", "discount", "hsn_code"],
    "dealer_details": ["dealer_name", "dealer_address", "dealer_gstin", "dealer_pan"],
}

#: Intents by pattern, first match wins: fixed values.
INTENTS = [
    ("SUPPORT_INTENT", r"help|support|complaint|human|call me|contact support|representative|agent|operator"),
    ("RECENT_EMAILS", r"(latest|recent|today|last|newest|today's) (mail|email|message|inbox)s?"),
    ("ORGANIZATION_SPECIFIC", r"services?|pricing|cost|charges?|fee|staff|policies|contact|location|appointments?|book|products?|operations?"),
    ("GRAPH_SUMMARY", r"summarize|summary|overview|tldr|briefly explain|main points|give me a breakdown|tell me everything about"),
    ("CHUNK_SEARCH", r"email|address|phone|who is|what is the name|exact quote|define|definition|where is|when did|what is the price|percentage"),
    ("CHAIN_OF_THOUGHT", r"why did|how did|what influenced|explain the reasoning|step by step|compare|contrast|analyze|pros and cons"),
    ("MEMORY_ONLY", r"what did i say|remember|preferences|previously|earlier|last time|my style"),
    ("ENTITY_CONNECTION", r"connection between|how is .* related to|relation|link between"),
    ("SOCIAL", r"hi|hello|hey|greetings|good morning|good afternoon|good evening|how are you|who are you|thanks|thank you|bye|goodbye"),
    ("TABLE_ANALYTICS", r"average|avg|sum|total|count|how many|highest|lowest|max|min|group by|top \d+|bottom \d+|order by"),
]

#: Words that acronyms may leave out: fixed values.
SMALL_WORDS = ["and", "of", "the", "for", "in", "to", "a", "an", "with", "by", "at", "on"]


def entity_group(name: Column) -> Column:
    """The group a field belongs to, null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for g, es in ENTITY_GROUPS.items() for e in es for x in (e, g)]), F.coalesce(F.lower(F.trim(name)), F.lit("")))


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def display_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"^(?i:mr|mrs|ms|dr|prof)\b\.?\s*", ""))


def normalized_name(c: Column) -> Column:
    return F.lower(display_name(c))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")


def acronym_match(a: Column, b: Column) -> Column:
    """Whether the shorter name is made of the initials of the longer one, small words counted or not."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    short, long = F.when(F.length(x) > F.length(y), y).otherwise(x), F.when(F.length(x) > F.length(y), x).otherwise(y)
    short = F.regexp_replace(short, "[. ]", "")
    words = F.filter(F.split(long, r"[\s-]+"), lambda w: w != "")
    main = F.filter(words, lambda w: ~w.isin(*SMALL_WORDS))
    made = (initials(words) == short) | (initials(main) == short)
    return F.when((F.length(x) == 0) | (F.length(y) == 0), False).when(x == y, True).otherwise((F.length(short) >= 2) & made)


def predicate(c: Column) -> Column:
    key = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    return F.coalesce(lookup(PREDICATES, key), F.upper(key))


def uri(base: str, kind: Column, text: Column) -> Column:
    """A percent-encoded URI: letters, digits and ``_.-~`` stay, a space becomes an underscore."""
    plain = F.replace(F.lower(text), F.lit(" "), F.lit("_"))
    coded = F.url_encode(plain)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), F.lower(kind), F.lit("/"), coded)


def header(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def parse_numeric(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"[^0-9.]", ""), F.lit("")).try_cast("double")


def mapped_column(row: Column, aliases: list[str]) -> Column:
    """The value of the first alias that the row (a map with lower-cased keys) has."""
    return F.coalesce(*[row[a] for a in aliases])


def labelled_text(labels: dict[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in labels.items()])


def exact_terms(c: Column) -> Column:
    digits = F.regexp_extract_all(c, F.lit(r"\b\d{4,}\b"), F.lit(0))
    return F.array_distinct(F.concat(digits, F.regexp_extract_all(c, F.lit(r"\b[A-Za-z0-9\-.]{5,}\b"), F.lit(0))))


def tokens_by_words(c: Column, factor: float) -> Column:
    return F.floor(F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+"))) * factor).cast("long")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def duration(seconds: Column) -> Column:
    m, s = F.floor(seconds / 60), seconds % 60
    return F.when(seconds < 60, F.format_string("%dSec", seconds)).when(s == 0, F.format_string("%dMins", m)).otherwise(F.format_string("%dMins %dSec", m, s))


def title(c: Column) -> Column:
    return F.when(F.length(c) > 80, F.concat(F.substring(c, 1, 80), F.lit("..."))).otherwise(c)


def source_type(path: Column) -> Column:
    p = F.lower(F.regexp_replace(path, r"\?.*$", ""))
    kind = F.lit("pdf")
    for end, name in ((".txt", "txt"), (".docx", "docx"), (".csv", "csv"), (".xlsx", "excel"), (".xls", "excel")):
        kind = F.when(p.endswith(end), name).otherwise(kind)
    return F.when(p.endswith(".pdf"), "pdf").when(p.startswith("http") & (kind == "pdf"), "url").otherwise(kind)


def intent(c: Column) -> Column:
    """The first intent whose pattern occurs, for texts of up to five words; others go to the model."""
    out = F.lit("MODEL")
    for name, p in reversed(INTENTS):
        out = F.when(c.rlike(rf"(?i)\b({p})\b"), name).otherwise(out)
    return F.when(F.size(F.split(F.trim(c), r"\s+")) <= 5, out).otherwise("MODEL")


def moved_weight(w: Column, step: Column) -> Column:
    return F.least(F.lit(2.0), F.greatest(F.lit(0.1), w + step))


#: The markdown cleaner's rules in order: fixed patterns.
MARKDOWN = [
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"```\w*\n?", ""),
    (r"</?(?:h[1-6]|p|div|tr|li|table|thead|tbody|ol|ul|br|section|article)[^>]*>", "\n"),
    (r"<[^>]+>", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"(?<!\w)_([^_]+)_(?!\w)", "$1"),
    (r"~~([^~]+)~~", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^(?:\|[^\n]+\|\r?\n)+", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d{1,2}\.\s+", ""),
    (r"(?m)^[-*_]{3,}\s*$", ""),
    (r"\n{3,}", "\n\n"),
    (r"(?m)^[ \t]+|[ \t]+$", ""),
    (r"^\s+|\s+\z", ""),
]


def plain_markdown(c: Column) -> Column:
    for p, to in MARKDOWN:
        c = F.regexp_replace(c, p, to)
    return c
