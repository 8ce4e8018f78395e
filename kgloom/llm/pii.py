"""Personal data by weak supervision, on DataFrame and SQL functions alone.

Patterns wider than the rules propose candidate spans. Labelers vote on each:
the strict pattern, a checksum, a gazetteer (calling codes, mail domains, network
blocks) and context words before the span; votes are 1, -1 or abstain. Candidates
are counted by kind, votes and classifier features (a table whose size depends on
the labelers and features alone), expectation-maximisation on these counts
estimates each labeler's reliability, and its posteriors train a logistic span
classifier on the features, which is applied as a column expression. Spans that
meet the fixed rules are always kept; the classifier adds others.

Matches have places by splitting the text at the matches: lengths of what lies
between and of the matches add up to code-point offsets. Patterns are written
with possessive runs and a test of the character before, so that a text of any
length is matched in time proportional to it; results are those of the plain
patterns, leftmost and non-overlapping.

Results leave an array only by its stretches (``scan``), so a text with very many
matches takes time in proportion to them.

Defined results: null text is empty; no span gives an empty string and its hash;
spans with one start are in the order of their kinds; repeated rows and ids are
rows of their own; very long texts are read whole; an empty table gives no rows;
other columns, whatever their names, are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import drop_written, written

KINDS = ("email", "ip", "card", "phone")

#: What must be in a text for the pattern to be tried at all.
TRIGGER = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "digits": r"[0-9]{3}", "handle": r"(?i)[\[(]at[\])]", "spelled": "(?i) dot "}

#: Candidate patterns. The first four have the spans of the fixed rules.
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "digits": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "handle": r"[A-Za-z0-9._%+-]{1,64}+\x20?+[\[(](?i:at)[\])]\x20?+[A-Za-z0-9-]{1,64}+(?:\.[A-Za-z0-9-]{1,64}+)++",
    "spelled": r"[A-Za-z0-9._%+-]{1,64}+\x20(?i:at)\x20[A-Za-z0-9-]{1,64}+(?:\x20(?i:dot)\x20[A-Za-z0-9-]{1,64}+)++",
}

#: Context words, in four languages: fixed values.
CONTEXT = {
    "email": ["mail", "email", "e-mail", "correo", "courriel", "contact", "kontakt"],
    "ip": ["ip", "host", "server", "address", "adresse", "ping"],
    "card": ["card", "visa", "tarjeta", "carte", "karte", "credit"],
    "phone": ["phone", "tel", "call", "fax", "mobile", "telefon", "llame", "appelez"],
}
#: Words that speak against personal data before a number: fixed values.
AGAINST = ["version", "section", "page", "isbn", "order", "id", "no", "seite", "figure"]
#: Assigned country calling codes by first digits: fixed values.
CALLING = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6][0-9]|35[0-9]|37[0-9]|38[0-9]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|69[0-2]|85[0-6]|88[0-8]|96[0-8]|97[0-7]|99[2-8])"
DOMAINS = r"(?i)(?:\.|\x20dot\x20)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us)$"
PRIVATE_NETS = r"^(10|127|0|255)\.|^192\.168\."

VOTES = ("strict", "checksum", "gazetteer", "context")


#: Items that ``scan`` walks in one go.
STRETCH = 256


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], of: str, to: str) -> Column:
    """Array of out(state, item) for every item, the state going on by step(state, item). ``of`` and ``to`` are the types
    of states and results. Arrays only grow within a stretch, and by one entry a stretch, so
    that the time is in proportion to the items for all but astronomically many."""
    part = lambda a, c: F.slice(a, (c * STRETCH + 1).cast("int"), F.lit(STRETCH))

    def walked(a: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(a) - 1) / STRETCH).cast("int")))
        begin = F.struct(zero.alias("state"), F.array().cast(f"array<{of}>").alias("starts"))
        starts = F.aggregate(stretches, begin, lambda s, c: F.struct(F.aggregate(part(a, c), s["state"], step).alias("state"), F.concat(s["starts"], F.array(s["state"])).alias("starts")), lambda s: s["starts"])
        none = F.array().cast(f"array<{to}>")
        one = lambda state, c: F.aggregate(part(a, c), F.struct(state.alias("state"), none.alias("out")), lambda s, x: F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(out(s["state"], x))).alias("out")), lambda s: s["out"])
        return F.flatten(F.transform(starts, one))

    return once(items, walked)


PLACE = "struct<source:string,start:bigint,end:bigint,value:string,before:string>"


def placed(kind: str) -> Column:
    """Array of structs (source, start, end, value, before): start and end in code points."""
    text = F.col("text")
    # what lies before each match, and the match
    pairs = once(F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0)), lambda m: F.zip_with(F.slice(F.split(text, PATTERN[kind], -1), F.lit(1), F.size(m)), m, lambda g, x: F.struct(g.alias("g"), x.alias("m"))))

    def place(at: Column, x: Column) -> Column:
        begin = at + F.length(x["g"])
        return F.struct(F.lit(kind).alias("source"), begin.alias("start"), (begin + F.length(x["m"])).alias("end"), x["m"].alias("value"), F.lower(F.right(x["g"], F.lit(24))).alias("before"))

    found = scan(pairs, F.lit(0).cast("bigint"), lambda at, x: at + F.length(x["g"]) + F.length(x["m"]), place, "bigint", PLACE)
    return F.when(text.rlike(TRIGGER[kind]), found).otherwise(F.array().cast(f"array<{PLACE}>"))


def luhn(digits: Column) -> Column:
    """Whether the last digit checks, doubling every second one from the right."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits))), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.element_at(d, i).cast("int")).otherwise(F.element_at(d, i).cast("int") * 2 - F.when(F.element_at(d, i) >= "5", 9).otherwise(0)))
    return total % 10 == 0


def judged(x: Column) -> Column:
    """A candidate with its kind, its place, whether it meets the fixed rule, votes and features."""
    source, value, before = x["source"], x["value"], x["before"]
    kind = F.when(source == "digits", "phone").when(source.isin("handle", "spelled"), "email").otherwise(source)
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))), F.lit(3)).cast("int"), F.lit(0)) <= 255)
    octets = F.forall(F.split(value, "\\."), small)
    checks = F.when((n >= 14) & (n <= 19), luhn(digits)).otherwise(False)
    base = F.when(source == "email", True).when(source == "ip", octets).when(source == "card", (n >= 14) & (n <= 19) & checks).when(source == "phone", (n >= 10) & (n <= 15)).otherwise(False)
    near = F.when(kind == "email", before.rlike(_pattern(CONTEXT["email"]))).when(kind == "ip", before.rlike(_pattern(CONTEXT["ip"]))).when(kind == "card", before.rlike(_pattern(CONTEXT["card"]))).otherwise(before.rlike(_pattern(CONTEXT["phone"])))
    far = before.rlike(_pattern(AGAINST))
    strict = F.when(base, 1).otherwise(-1)
    checksum = F.when(source == "card", F.when(checks, 1).otherwise(-1)).when(source == "ip", F.when(octets, 1).otherwise(-1)).otherwise(0)
    gazetteer = (
        F.when(source == "phone", F.when(value.rlike(CALLING), 1).otherwise(-1))
        .when(kind == "email", F.when(value.rlike(DOMAINS), 1).otherwise(0))
        .when(source == "ip", F.when(value.rlike(PRIVATE_NETS), -1).otherwise(0))
        .when(source == "card", F.when(value.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(-1))
        .otherwise(0)
    )
    context = F.when(near & ~far, 1).when(far & ~near, -1).otherwise(0)
    size = F.when(n < 8, 0).when(n < 10, 1).when(n <= 12, 2).when(n <= 15, 3).when(n <= 19, 4).otherwise(5)
    return F.struct(
        kind.alias("kind"),
        source.alias("source"),
        x["start"].alias("start"),
        x["end"].alias("end"),
        base.alias("base"),
        strict.alias("strict"),
        checksum.alias("checksum"),
        gazetteer.alias("gazetteer"),
        context.alias("context"),
        size.alias("size"),
        F.when(value.rlike(r"[ ()-]"), 1).otherwise(0).alias("spaced"),
    )


def _pattern(words: list[str]) -> str:
    return r"(?<![\p{L}])(" + "|".join(words) + r")(?![\p{L}])"


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the array ``found`` of judged candidates of every document."""
    d = docs.select(*[F.col(c).alias(f"_k_{c}") for c in keep], F.coalesce("text", F.lit("")).alias("text"))
    for kind in PATTERN:
        d = d.withColumn(f"_{kind}", placed(kind))
    found = F.transform(F.concat(*[F.col(f"_{k}") for k in PATTERN]), judged)
    d = d.select(*[f"_k_{c}" for c in keep], found.alias("found"))
    return d.select(*[F.col(f"_k_{c}").alias(c) for c in keep], undisputed(F.col("found")).alias("found"))


def undisputed(found: Column) -> Column:
    """Candidates without those of a wider pattern that overlap with a span of the rules' own patterns. In the order
    of starts, that is seen from the farthest end before and the nearest start after."""
    own = lambda x: x["source"].isin(*KINDS)
    low, high = F.lit(-1).cast("bigint"), F.lit((1 << 62)).cast("bigint")

    def check(a: Column) -> Column:
        x = lambda s: s["x"]
        before = scan(a, low, lambda end, s: F.when(own(x(s)), F.greatest(end, x(s)["end"])).otherwise(end), lambda end, s: end, "bigint", "bigint")
        after = F.reverse(scan(F.reverse(a), high, lambda start, s: F.when(own(x(s)), x(s)["start"]).otherwise(start), lambda start, s: start, "bigint", "bigint"))
        limits = F.zip_with(before, after, lambda b, e: F.struct(b.alias("b"), e.alias("e")))
        marked = F.zip_with(a, limits, lambda s, t: F.struct(x(s).alias("x"), (own(x(s)) | ((t["b"] <= x(s)["start"]) & (t["e"] >= x(s)["end"]))).alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), x)

    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x.alias("x"))))
    return F.when(F.exists(found, lambda x: ~own(x)) & F.exists(found, own), once(ordered, check)).otherwise(found)


# ------------------------------------------------------------------- learning

FEATURES = ("kind", "source", "checksum", "gazetteer", "context", "size", "spaced")


def patterns(found: DataFrame) -> list[dict]:
    """How often each combination of votes and features occurs. Combinations are bounded
    by the labelers' and features' values, not by the input."""
    x = found.select(F.explode("found").alias("x")).select("x.*")
    names = dict.fromkeys([*FEATURES, *VOTES, "base"])
    return [r.asDict() for r in x.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]


def reliabilities(rows: list[dict], rounds: int = 50) -> tuple[dict, list[float]]:
    """Expectation-maximisation over the votes: for each kind the prior and, for each
    labeler, the chances of a vote for and against given the truth; and the posterior
    of each row. The prior belief is that labelers are right more often than not."""
    posterior = [0.9 if r["strict"] > 0 else 0.2 for r in rows]
    learned: dict = {}
    for _ in range(rounds):
        learned = {}
        for kind in {r["kind"] for r in rows}:
            own = [(r, p) for r, p in zip(rows, posterior, strict=True) if r["kind"] == kind]
            total = sum(r["n"] for r, _ in own)
            yes = sum(r["n"] * p for r, p in own)
            chances = {}
            for v in VOTES:
                for vote in (-1, 0, 1):
                    for truth in (0, 1):
                        mass = sum(r["n"] * (p if truth else 1 - p) for r, p in own if r[v] == vote)
                        all_mass = yes if truth else total - yes
                        right = vote == (1 if truth else -1)
                        chances[v, vote, truth] = (mass + (4.0 if right else 1.0)) / (all_mass + (4.0 + 2.0))
            learned[kind] = ((yes + 1.0) / (total + 2.0), chances)
        for i, r in enumerate(rows):
            prior, chances = learned[r["kind"]]
            odds = math.log(prior / (1 - prior)) + sum(math.log(chances[v, r[v], 1] / chances[v, r[v], 0]) for v in VOTES)
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return learned, posterior


def train(rows: list[dict], posterior: list[float], rounds: int = 300) -> dict[tuple[str, str], float]:
    """Weights of a logistic classifier on one-hot features, fitted to the posteriors."""
    weights: dict[tuple[str, str], float] = {("", ""): 0.0}
    total = sum(r["n"] for r in rows) or 1
    keys = [[("", ""), *((f, str(r[f])) for f in FEATURES)] for r in rows]
    for ks in keys:
        for k in ks:
            weights.setdefault(k, 0.0)
    for step in range(rounds):
        slope = dict.fromkeys(weights, 0.0)
        for r, p, ks in zip(rows, posterior, keys, strict=True):
            z = sum(weights[k] for k in ks)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * r["n"] / total
            for k in ks:
                slope[k] += error
        for k in weights:
            weights[k] -= 2.0 * (slope[k] + 1e-4 * weights[k])
    return weights


def fit(docs: DataFrame) -> dict[tuple[str, str], float]:
    # written, as a plan that explodes an array looks at it twice
    found = written(candidates(docs, []))
    rows = patterns(found)
    drop_written(found)
    return train(rows, reliabilities(rows)[1])


def accepted(x: Column, weights: dict[tuple[str, str], float]) -> Column:
    z = F.lit(weights.get(("", ""), 0.0))
    for f in FEATURES:
        part = F.lit(0.0)
        for (name, value), w in sorted(weights.items()):
            if name == f:
                part = F.when(x[f].cast("string") == value, F.lit(w)).otherwise(part)
        z = z + part
    return x["base"] | (z >= 0)


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as listed, as structs (start, rank, end, kind, base)."""
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``found``: ordered accepted spans of every document."""
    table = written(candidates(docs, keep))
    rows = patterns(table)
    weights = train(rows, reliabilities(rows)[1])
    return table.select(*keep, in_order(F.filter("found", lambda x: accepted(x, weights))).alias("found"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets; ``n_chars``, where there is one, follows."""
    weights = fit(docs)
    with_text = candidates(docs.withColumn("_row", F.struct(*docs.columns)), ["_row"])
    with_text = with_text.withColumn("found", in_order(F.filter("found", lambda x: accepted(x, weights))))
    spans = F.col("found")
    text = F.col("_row.text")
    # where the text before a span was used up, and the span
    walked = scan(spans, F.lit(0).cast("bigint"), lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.struct(at.alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")), "bigint", "struct<at:bigint,start:bigint,end:bigint,kind:string>")
    cut = lambda t, at, n: F.substring(t, (at + 1).cast("int"), n.cast("int"))

    def replaced(part: Column) -> Column:
        """The text of a stretch of spans: each is looked up in the stretch's own text, not from the start of all."""
        origin, last = F.element_at(part, 1)["at"], F.element_at(part, -1)
        block = cut(text, origin, F.greatest(last["at"], last["end"]) - origin)
        mark = lambda x: F.when((x["end"] > x["at"]) & (x["start"] >= x["at"]), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return once(block, lambda b: F.array_join(F.transform(part, lambda x: F.concat(cut(b, x["at"] - origin, F.greatest(x["at"], x["start"]) - x["at"]), mark(x))), ""))

    def joined(a: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STRETCH).cast("int"))
        parts = F.transform(stretches, lambda c: once(F.slice(a, (c * STRETCH + 1).cast("int"), F.lit(STRETCH)), replaced))
        end = F.element_at(a, -1)
        return F.concat(F.array_join(parts, ""), cut(text, F.greatest(end["at"], end["end"]), F.length(text)))

    new = F.when(F.size("found") > 0, once(walked, joined)).otherwise(text)
    out = with_text.select("_row", new.alias("_new"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_new").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("_new").eqNullSafe(F.col("_row.text")), F.col("_row.n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col("_row").getField(c).alias(c))
    return out.select(*columns)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    base = F.filter("found", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
