"""Rule layers over triples (s, p, o): what follows from a schema, which facts a rule matrix allows, and what violates a shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.sources.readers import drop, kept

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, INVERSE, TRANSITIVE = "type", "subClassOf", "subPropertyOf", "domain", "range", "inverseOf", "TransitiveProperty"
#: The type that stands for any other in a rule: a fixed value.
ANY_TYPE = "CONCEPT"
KEY = ["s", "p", "o"]


def transitive_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b) for every chain of ``pairs`` (a, b), so that each round doubles the chains that are known. Written."""
    known = kept(pairs.select("a", "b").where("a <> b").distinct(), "closure")
    new = known
    while True:
        ahead = known.select(F.col("a").alias("b"), F.col("b").alias("c"))
        longer = new.join(ahead, "b").union(new.select(F.col("a").alias("b"), F.col("b").alias("c")).join(known, "b").select("b", "a", "c")).select("a", F.col("c").alias("b"))
        fresh = kept(longer.where("a <> b").distinct().join(known, ["a", "b"], "left_anti"), "closure")
        if fresh.isEmpty():
            drop(fresh)
            return known
        grown = kept(known.union(fresh), "closure")
        known, new = grown, fresh


def consequences(triples: DataFrame) -> DataFrame:
    """``triples`` with all that follows from their schema: subclass and subproperty chains, domains, ranges, inverse and
    transitive properties, and what follows from that again.

    Semi-naive: a round joins only what the round before found, with the rules, which are one table by property, and
    for transitive properties with the facts; it ends when nothing is new. Facts are distinct; a schema statement is a fact like others.
    Circles in the schema end too. Written."""
    facts = triples.select(*KEY).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()
    known = kept(facts, "facts")
    of = lambda p: known.where(F.col("p") == p)
    pairs = lambda p: of(p).select(F.col("s").alias("a"), F.col("o").alias("b"))
    classes = transitive_pairs(pairs(SUBCLASS))
    properties = transitive_pairs(pairs(SUBPROPERTY))
    # one rule a row: a fact with property p (and object o, if given) gives another with property q
    rule = lambda df, kind, p, q: df.select(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))
    rules = rule(properties, "same", F.col("a"), F.col("b")).union(rule(of(DOMAIN), "subject", F.col("s"), F.col("o"))).union(rule(of(RANGE), "object", F.col("s"), F.col("o")))
    rules = rules.union(rule(of(INVERSE), "turned", F.col("s"), F.col("o"))).union(rule(of(INVERSE), "turned", F.col("o"), F.col("s")))
    rules = kept(rules.distinct(), "rules")
    chained = kept(known.where((F.col("p") == TYPE) & (F.col("o") == TRANSITIVE)).select(F.col("s").alias("p")).distinct(), "rules")
    schema = classes.select(F.col("a").alias("s"), F.lit(SUBCLASS).alias("p"), F.col("b").alias("o")).union(properties.select("a", F.lit(SUBPROPERTY), "b"))
    new = schema.join(known, KEY, "left_anti")
    start = kept(known.union(new), "facts")
    drop(known)
    known = new = start
    while True:
        by_rule = new.join(rules, "p")
        kind = F.col("kind")
        made = by_rule.select(
            F.when(kind.isin("turned", "object"), F.col("o")).otherwise(F.col("s")).alias("s"),
            F.when(kind.isin("subject", "object"), F.lit(TYPE)).otherwise(F.col("q")).alias("p"),
            F.when(kind == "same", F.col("o")).when(kind == "turned", F.col("s")).otherwise(F.col("q")).alias("o"),
        )
        typed = new.where(F.col("p") == TYPE).join(classes.select(F.col("a").alias("o"), "b"), "o").select("s", "p", F.col("b").alias("o"))
        links, fresh_links = known.join(chained, "p", "left_semi"), new.join(chained, "p", "left_semi")
        step = lambda x, y: x.select("p", "s", F.col("o").alias("m")).join(y.select("p", F.col("s").alias("m"), "o"), ["p", "m"]).select(*KEY)
        found = made.union(typed).union(step(fresh_links, links)).union(step(links, fresh_links)).where("s IS NOT NULL AND o IS NOT NULL").distinct()
        new = kept(found.join(known, KEY, "left_anti"), "facts")
        if new.isEmpty():
            drop(new, rules, chained, classes, properties)
            return known
        grown = kept(known.union(new), "facts")
        known = grown


def routed(facts: DataFrame) -> DataFrame:
    """Facts (mode, predicate, event_name, n_participants, n_attributes, ...) with their mode: an event if they say so, have an attribute, or three
    participants; an event without a name takes its predicate's."""
    event = (F.col("mode") == "event") | (F.coalesce("n_attributes", F.lit(0)) > 0) | (F.coalesce("n_participants", F.lit(0)) >= 3)
    named = F.when(event & (F.coalesce(F.trim("event_name"), F.lit("")) == ""), F.col("predicate")).otherwise(F.col("event_name"))
    return facts.withColumns({"mode": F.when(event, "event").otherwise("relationship"), "event_name": named})


def enforced(facts: DataFrame, matrix: DataFrame, strict: bool = True) -> DataFrame:
    """``facts`` with ``reason``, null where they are allowed. Relationships need a row (subject_type, predicate, object_type) of ``matrix``, where
    ANY_TYPE stands for any type on its side, unless rules aren't ``strict``; events need a name and a participant or an attribute."""
    bare = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rules = matrix.select(*[F.col(c).alias(f"_{c}") for c in ("subject_type", "predicate", "object_type")]).distinct().withColumn("_fine", F.lit(True))
    side = lambda c: F.array_distinct(F.array(c, F.lit(ANY_TYPE)))
    # each fact asks for its own types and for the wildcard: four keys at most
    asks = facts.where("mode = 'relationship'").select("subject_type", "predicate", "object_type").distinct()
    keys = asks.select("*", F.explode(side("subject_type")).alias("_subject_type")).select("*", F.col("predicate").alias("_predicate"), F.explode(side("object_type")).alias("_object_type"))
    fine = keys.join(rules, ["_subject_type", "_predicate", "_object_type"]).select(F.col("subject_type").alias("_s"), F.col("predicate").alias("_p"), F.col("object_type").alias("_o"), "_fine").distinct()
    told = facts.join(fine, F.expr("subject_type <=> _s AND predicate <=> _p AND object_type <=> _o"), "left").drop("_s", "_p", "_o")
    of_rule = F.concat(F.lit("OWL rule violation: "), F.coalesce("subject_type", F.lit("?")), F.lit(" -["), F.coalesce("predicate", F.lit("?")), F.lit("]-> "), F.coalesce("object_type", F.lit("?")))
    hollow = (F.coalesce("n_participants", F.lit(0)) + F.coalesce("n_attributes", F.lit(0))) == 0
    event = F.when(bare("event_name") == "", F.lit("event without a name")).when(hollow, F.lit("event with no participants or attributes"))
    empty = (bare("subject") == "") | (bare("object") == "") | (bare("predicate") == "")
    relation = F.when(empty, F.lit("empty subject, predicate or object")).when(F.col("_fine").isNull() & F.lit(strict), of_rule)
    return told.withColumn("reason", F.when(F.col("mode") == "event", event).otherwise(relation)).drop("_fine")


def violations(triples: DataFrame, shapes: list[dict]) -> DataFrame:
    """(focus, path, constraint, value) for every way in which a node of a shape's class violates it. A shape: ``target`` (a class), ``path`` (a
    property) and any of ``min``, ``max`` (how many values), ``pattern`` (that values match), ``type`` (a class of each value), ``one_of``.

    Counts are aggregated by node and property, so a node of any degree is fine. ``value`` is the count or the value that is wrong."""
    nodes = triples.where(F.col("p") == TYPE).select(F.col("s").alias("focus"), F.col("o").alias("target")).distinct()
    out = None
    for shape in shapes:
        focus = nodes.where(F.col("target") == shape["target"]).select("focus")
        values = triples.where(F.col("p") == shape["path"]).select(F.col("s").alias("focus"), F.col("o").alias("value")).distinct()
        of: list[tuple[str, DataFrame, Column]] = []
        if "min" in shape or "max" in shape:
            counted = focus.join(values.groupBy("focus").agg(F.count(F.lit(1)).alias("n")), "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))
            counted = counted.withColumn("value", F.col("n").cast("string"))
            of += [("minCount", counted, F.col("n") < shape["min"])] if "min" in shape else []
            of += [("maxCount", counted, F.col("n") > shape["max"])] if "max" in shape else []
        held = values.join(focus, "focus", "left_semi")
        if "pattern" in shape:
            of.append(("pattern", held, ~F.col("value").rlike(shape["pattern"])))
        if "one_of" in shape:
            of.append(("in", held, ~F.col("value").isin(*shape["one_of"])))
        if "type" in shape:
            typed = nodes.where(F.col("target") == shape["type"]).select(F.col("focus").alias("value"))
            of.append(("class", held.join(typed, "value", "left_anti"), F.lit(True)))
        for name, df, wrong in of:
            part = df.where(wrong).select("focus", F.lit(shape["path"]).alias("path"), F.lit(name).alias("constraint"), "value")
            out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("no shape has a constraint")
    return out
