"""Personal data: four fixed kinds by pattern, then bootstrapped contextual extraction, built-in functions only.

The fixed kinds (e-mail and IP addresses, card and phone numbers) are the seeds. Every token that looks like
an identifier (two digits or an @) is an instance; its lexical patterns are the word before it, the two words
before it, the word after it, and a label inside the token (`label=`). Instances that hold a seed count for their
patterns; those of a fixed kind's form that fail its check (a number that is no card) count against them, and so do
all others by UNKNOWN until they are accepted.

Patterns and instances form a graph, scored in ROUNDS rounds: a pattern's confidence is the share of its
instances that are seeds or, by their scores, accepted, an instance's score the mean confidence of its patterns that SUPPORT
seeds or accepted instances have, weighted by log(1 + support). An instance is accepted from a score of ACCEPT and a weight
of WEIGHT on. So labels that only accepted instances have become patterns of later rounds. Edges are
distinct pairs; a pattern that a third of them share meets its confidence in SALTS tasks.

Patterns are written for Java's engine so that no long text makes it recurse or scan a run twice: repeats are possessive
where giving back can't help, and a match begins at a run's start or where the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textblocks import checkpointed

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BLANK = r"\x20\x09-\x0D"
#: A token of six characters at least with two digits or an @, or a phone or card number with blanks, to the end of its last token.
INSTANCE = rf"(?<![^{_BLANK}])(?:\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){{12,18}}+|(?=[^{_BLANK}]*?(?:@|[0-9][^{_BLANK}]*?[0-9]))[^{_BLANK}]{{6}})[^{_BLANK}]*+"
#: Characters of the text around an instance that its patterns may come from.
CONTEXT = 64
ROUNDS = 3
SUPPORT = 3
ACCEPT = 0.8
UNKNOWN = 0.25
WEIGHT = 2.8
SALTS = 16
#: Matches of a text whose lengths are summed one by one; longer lists go by sums of so many.
_STRIDE = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b)).cast("int")


def matches(text: Column, form: str) -> Column:
    """The leftmost non-overlapping matches as (start, stop, value, before, after): code points, stop exclusive, and the texts up to the next matches.

    split gives what is between the matches, so a match starts at the sum of the lengths before it.
    """
    total = lambda lengths: F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts(steps: Column) -> Column:
        def placed(lengths: Column) -> Column:
            chunks = F.sequence(F.lit(0), _div(F.greatest(F.size(lengths) - 1, F.lit(0)), _STRIDE))
            sums = F.transform(chunks, lambda k: total(F.slice(lengths, k * _STRIDE + 1, F.lit(_STRIDE))))

            def from_sums(s: Column) -> Column:
                return _let(F.transform(s, lambda _, k: total(F.slice(s, F.lit(1), k))), lambda before: F.transform(steps, lambda x, i: at(x, i, before)))

            def at(x: Column, i: Column, before: Column) -> Column:
                start = F.get(before, _div(i, _STRIDE)) + total(F.slice(lengths, _div(i, _STRIDE) * _STRIDE + 1, i % _STRIDE)) + F.length(x["before"])
                return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("stop"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))

            return _let(sums, from_sums)

        return _let(F.transform(steps, lambda x: (F.length(x["before"]) + F.length(x["value"])).cast("long")), placed)

    def stepped(parts: Column) -> Column:
        return _let(F.regexp_extract_all(text, F.lit(form), F.lit(0)), lambda values: _let(F.transform(values, lambda v, i: F.struct(v.alias("value"), F.get(parts, i).alias("before"), F.get(parts, i + 1).alias("after"))), starts))

    return _let(F.split(text, form, -1), stepped)


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes: from the right, every second digit counts double, less 9 from 10 on."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind's form passes its check."""
    if kind == "ip":
        small = lambda p: _let(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) <= 3) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return _let(F.regexp_replace(value, "[^0-9]", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))


def fixed_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, stop>> of a fixed kind."""
    valid = F.filter(matches(text, FORMS[kind]), lambda m: is_valid(kind, m["value"]))
    spans = F.transform(valid, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))
    return F.when(_may_have(kind, text), spans).otherwise(F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>"))


def _checker(kind: str, check: bool) -> Callable[[Column], Column]:
    if check:
        return lambda v: is_valid(kind, v)
    if kind == "card":
        return lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(13, 19)
    return lambda v: F.lit(True)


def _holds(value: Column, check: bool) -> Column:
    """Whether a token holds a fixed kind's form, with check one that is valid."""
    found = F.lit(False)
    for kind in KINDS if check else KINDS[1:]:
        found = found | F.exists(F.regexp_extract_all(value, F.lit(FORMS[kind]), F.lit(0)), _checker(kind, check))
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and a key that tells documents apart, rows that repeat a doc_id included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text).cast("string"), F.length(text).cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key"))


def instances(keyed: DataFrame) -> DataFrame:
    """(key, start, stop, node, state, patterns): tokens that look like identifiers; state is 1 of seeds, 0 of failed forms, else null."""
    text = F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise("")
    # Of the texts around a match only the nearest characters go on.
    near = F.transform(matches(text, INSTANCE), lambda m: F.struct(m["start"].alias("start"), m["value"].alias("raw"), F.right(m["before"], F.lit(CONTEXT)).alias("before"), F.left(m["after"], F.lit(CONTEXT)).alias("after")))
    rows = keyed.select("key", F.explode(near).alias("m")).select("key", "m.*")
    lead = F.length(F.regexp_extract("raw", r"^[^\p{L}\p{N}+]*+", 0))
    rows = rows.withColumn("lead", lead).withColumn("core", F.regexp_replace(F.expr("substring(raw, lead + 1)"), r"(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++\z", ""))
    rows = rows.withColumn("label", F.regexp_extract("core", r"^(\p{L}[\p{L}_-]{0,30}+[=:]++)[^=:]", 1))
    value = F.expr("substring(core, length(label) + 1)")
    opening = F.length(F.regexp_extract(value, r"^[^\p{L}\p{N}+]*+", 0))
    rows = rows.withColumn("skip", F.col("lead") + F.length("label") + opening).withColumn("value", F.expr("substring(core, skip - lead + 1)"))
    word = lambda c, form: F.regexp_replace(F.lower(F.regexp_extract(c, form, 1)), "[0-9]", "0")
    last, two, next_ = word("before", rf"([^{_BLANK}]++)[{_BLANK}]*+\z"), word("before", rf"([^{_BLANK}]++[{_BLANK}]++[^{_BLANK}]++)[{_BLANK}]*+\z"), word("after", rf"^[{_BLANK}]*+([^{_BLANK}]++)")
    named = [(last, "before "), (two, "before2 "), (next_, "after "), (F.lower("label"), "label ")]
    patterns = F.filter(F.array(*(F.when(w != "", F.concat(F.lit(p), w)) for w, p in named)), lambda p: p.isNotNull())
    state = F.when(_holds(F.col("raw"), True), 1).when(_holds(F.col("raw"), False), 0)
    out = rows.select("key", (F.col("start") + F.col("skip")).alias("start"), (F.col("start") + F.col("skip") + F.length("value")).alias("stop"), F.xxhash64("value").alias("node"), state.alias("state"), patterns.alias("patterns"), F.length("value").alias("n"))
    return out.where("n > 0").drop("n")


def scored_instances(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT, weight: float = WEIGHT, unknown: float = UNKNOWN) -> DataFrame:
    """(node, score) of the accepted instances that are no seeds, from (node, state, patterns)."""
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    edges = checkpointed(found.select("node", "state", F.explode("patterns").alias("pattern")).groupBy("pattern", "node").agg(F.max("state").alias("state")).withColumn("salt", salt))
    accepted = None
    for _ in range(rounds):
        known = edges.withColumn("score", F.lit(None).cast("double")) if accepted is None else edges.join(accepted, "node", "left")
        held = F.when(F.col("state") == 1, 1.0).when(F.col("state") == 0, 0.0).otherwise(F.coalesce("score", F.lit(0.0)))
        patterns = known.groupBy("pattern").agg(F.sum(held).alias("good"), F.count(F.when(held > 0, 1)).alias("support"), F.sum(F.when(F.col("state").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(unknown)))).alias("n")).where(F.col("support") >= support)
        weighed = patterns.select("pattern", (F.col("good") / (F.col("n") + 1)).alias("confidence"), F.log1p("support").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = edges.where("state is null").join(weighed, ["pattern", "salt"])
        score = F.sum(F.col("w") * F.col("confidence")) / F.sum("w")
        # Sums of doubles in any order: what may differ in the last places is rounded off.
        accepted = checkpointed(met.groupBy("node").agg(F.round(score, 9).alias("score"), F.sum("w").alias("w")).where((F.col("score") >= accept) & (F.col("w") >= weight)).select("node", "score"))
    return accepted


def personal_spans(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT, weight: float = WEIGHT, unknown: float = UNKNOWN) -> DataFrame:
    """The personal data of documents.

    Returns doc_id, base and found, lists of (kind, start, stop) in code points, stop exclusive: base has the spans of the fixed
    kinds, by kind as KINDS lists them, then start; found the further identifiers, of kind `id`, by start. A null
    text is empty and has none; rows that repeat a doc_id have the spans of their own texts; a null doc_id stays null; an empty
    table gives no rows; other columns are ignored.
    """
    keyed = _keyed(docs)
    based = keyed.select("doc_id", "key", F.concat(*(fixed_spans(F.col("text"), k) for k in KINDS)).alias("base"))
    found = checkpointed(instances(keyed))
    accepted = scored_instances(found, rounds, support, accept, weight, unknown)
    more = found.where("state is null").join(accepted, "node").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("s"))
    ids = F.transform("s", lambda x: F.struct(F.lit("id").alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    joined = based.join(more, "key", "left")
    return joined.select("doc_id", "base", F.coalesce(ids, F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")).alias("found"))
