"""Document fingerprints by closed syncmers, with built-in functions only.

A text's tokens are its runs of non-blank characters, cut after every character that is
no ASCII consonant or mark (TOKEN): about syllables, single characters in scripts without
blanks. Where a cut falls depends on that character alone, so an inserted one changes the
tokens it touches. K consecutive tokens are a k-mer, S of them an s-mer; a k-mer is a
closed syncmer if its least s-mer, by hash, lies at its first or last place. That
depends on the k-mer alone, so an edit changes no anchor but those over it, and
equal stretches of two texts have equal anchors at a constant shift. A text whose k-mers
are no syncmers has the k-mer with the least s-mer, a text under K tokens all its s-mers. The
fingerprint is the sequence of anchors in text order. Texts are matched by position: a link is
two anchors that follow each other (or the text's start and the first one) and the distance between
their places, so two texts share it where both anchors lie at one shift between them. likeness is the share of
distinct links that two texts have in common: an insertion costs the links over it, the
same anchors in another order or at other distances have none.

A k-mer's K - S + 1 = 4 s-mers are compared in one pass over arrays within a row: there is no
shuffle below the query's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARKS = r"!-/:-@B-DF-HJ-NP-TV-Z\[-`b-df-hj-np-tv-z{-~"
TOKEN = rf"[{_MARKS}]*+[^\s{_MARKS}]|[{_MARKS}]++"
#: Tokens of an s-mer and of a k-mer; the K - S + 1 = 4 s-mers of a k-mer are compared one by one below.
S, K = 2, 5
_WINDOW = K - S + 1
#: The low bits of a placed anchor that hold its place.
_PLACE = (1 << 32) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda's variable is bound, an alias may be inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shift(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _paired(a: Column, by: int, use: Callable[[Column, Column], Column]) -> Column:
    """use(a[i], a[i + by]) for each i that has both."""
    size = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, size), _shift(a, by), use)


def _placed(anchor: Column, place: Column) -> Column:
    return F.shiftleft(anchor.cast("long"), 32).bitwiseOR(place.cast("long"))


def _anchors_of(tokens: Column) -> Column:
    def of_smers(smers: Column) -> Column:
        kmers = F.slice(smers, 1, F.greatest(F.size(smers) - (_WINDOW - 1), F.lit(0)))  # each by its first s-mer
        inner = lambda i: F.least(F.get(smers, i + 1), F.get(smers, i + 2))
        anchor = lambda i: _placed(F.hash(*(F.get(smers, i + j) for j in (0, 2, 3))), i + 1)  # noqa: E731  s-mers that cover all K tokens
        closed = F.filter(F.transform(kmers, lambda x, i: F.when(F.least(x, F.get(smers, i + 3)) <= inner(i), anchor(i))), F.isnotnull)
        low = F.transform(kmers, lambda x, i: F.least(x, inner(i), F.get(smers, i + 3)))
        least = _let(_let(low, lambda values: F.array_position(values, F.array_min(values)).cast("int") - 1), lambda i: F.array(anchor(i)))
        all_smers = F.transform(smers, lambda s, i: _placed(s, i + 1))
        found = _let(closed, lambda c: F.when(F.size(c) > 0, c).otherwise(least))
        return F.when(F.size(smers) >= _WINDOW, found).when(F.size(smers) > 0, all_smers).when(F.size(tokens) > 0, F.array(_placed(F.hash(tokens), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))

    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    return _let(_let(hashes, lambda h: _paired(h, S - 1, lambda a, b: F.hash(a, b))), of_smers)


def placed_anchors(text: Column) -> Column:
    """The closed syncmers of a text as an array of long, in text order: the anchor above, its token's place (from 1) in the low 32 bits.

    Under K tokens: the s-mers, or the one token there is; without tokens: none.
    """
    return _let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _anchors_of)


def anchors(text: Column) -> Column:
    """placed_anchors without the places, as an array of int."""
    return F.transform(placed_anchors(text), lambda a: F.shiftright(a, 32).cast("int"))


def fingerprint(found: Column) -> Column:
    """Placed anchors as eight hex digits each, without their places."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.lpad(F.hex(F.shiftrightunsigned(a, 32)), 8, "0")), ""))


def links(found: Column) -> Column:
    """Of placed anchors in text order: a hash of each two that follow each other and their distance; the text's start, place 0, comes before the first."""
    # y without x's place: y's anchor above the distance.
    link = lambda x, y: F.xxhash64(F.shiftright(x, 32), y - x.bitwiseAND(_PLACE))
    return _let(F.concat(F.array(F.lit(0).cast("long")), found), lambda all_: _paired(all_, 1, link))


def _printed(text: Column) -> Column:
    """A text's fingerprint and links, of anchors found once."""
    return _let(placed_anchors(text), lambda found: F.struct(fingerprint(found).alias("fingerprint"), links(found).alias("links")))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Share of the distinct links of both that both have; where neither has any, 1 for equal texts and 0 for others."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, equal.cast("double")).otherwise(both / all_)


def with_next(docs: DataFrame, columns: list[str], id_column: str = "doc_id", derived: dict[str, Column] | None = None) -> DataFrame:
    """docs with the columns of `derived`, which are made after the shuffle, and the struct `next_row` of the row with the next larger id, after the last one that of the first.

    Rows are dealt into ranges of the id whose lower bounds are ids of the table; the first row of
    each range is also given to the range before it (of the first range, to the last), so each
    range finds all its successors. Equal ids follow each other in the order of `columns`.
    """
    # More ranges than tasks: ranges are dealt by a hash.
    partitions = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.where(F.col(id_column).isNotNull()).agg(F.percentile_approx(id_column, [i / partitions for i in range(partitions)], F.lit(10 * partitions))).first()[0]
    bounds = sorted(set(bounds or []))
    if not bounds:
        derived = derived or {}
        return docs.withColumns(derived).withColumn("next_row", F.struct(*columns, *derived)).where(F.lit(False))
    low = F.array(*map(F.lit, bounds))
    at = F.when(F.col(id_column) >= bounds[0], F.size(F.filter(low, lambda b: b <= F.col(id_column))) - 1).otherwise(0)
    order = [id_column, *columns]
    ranged = docs.withColumn("range", at)
    # The first range's lower bound is the least id: the 0th percentile.
    heads = F.filter(F.sequence(F.lit(0), F.lit(len(bounds) - 1)), lambda i: F.get(low, i) == F.col(id_column))
    copies = F.transform(heads, lambda i: F.struct(F.when(i == 0, len(bounds) - 1).otherwise(i - 1).alias("range"), F.lit(1).alias("copy")))
    dealt = ranged.withColumn("to", F.explode(F.concat(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("copy"))), copies))).drop("range").select(*docs.columns, "to.*")
    derived = derived or {}
    dealt = dealt.repartition(F.col("range")).withColumns(derived)
    window = Window.partitionBy("range").orderBy("copy", *order)
    return dealt.withColumn("next_row", F.lead(F.struct(*columns, *derived)).over(window)).where("copy = 0").drop("range", "copy")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edited text and the next document's, and compare them.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's text, by ascending doc_id; after the last comes the first. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    A null text counts as empty; texts without tokens have the empty fingerprint and are alike only
    where they are equal.
    Rows that repeat a doc_id are ordered by their texts. A row with null doc_id comes before all
    others. Other columns are ignored; an empty table gives no rows.
    """
    # A null id sorts first and may not bound a range, so it gets the id below all others.
    texts = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("place"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    paired = with_next(texts, ["text"], "place", {"print": _printed(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_row.text", F.lit(1), half))
    made = paired.select("own_id", F.length("text").cast("long").alias("n_chars"), "print", F.col("next_row.print.links").alias("next_links"), edited.alias("edited"), (F.col("text") == F.col("next_row.text")).alias("same_next"), (F.col("text") == edited).alias("same_edited"))
    done = made.select("own_id", "n_chars", "print", "next_links", "same_next", "same_edited", F.sha2("edited", 256).alias("edited_sha256"), _printed(F.col("edited")).alias("edited_print"))
    return done.select(
        F.col("own_id").alias("doc_id"), "n_chars", "edited_sha256", F.col("print.fingerprint").alias("fingerprint"), F.col("edited_print.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("print.links"), F.col("edited_print.links"), F.col("same_edited")).alias("near_edited"), likeness(F.col("print.links"), F.col("next_links"), F.col("same_next")).alias("near_next"),
    )
