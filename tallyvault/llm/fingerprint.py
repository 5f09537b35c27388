"""Fingerprints of whole documents that survive small edits.

Method: I-Match.  The lexicon holds the terms whose document frequency lies in a band
(a band of inverse document frequency).  A document keeps its distinct terms of the
lexicon, sorts them and hashes them, once for each of several randomised subsets of the
lexicon; an edit changes only the hashes of the subsets that hold a term it touches.
The subsets come in tiers, from an eighth to a 512th of the lexicon, so that short and long
documents both have a tier whose subsets hold one or two of their terms; the likeness of two
fingerprints is that of the tier that fits them best.

DataFrame and SQL functions only.  Documents are dealt once into ranges of ids, small
enough for a task; a document's neighbour, its edited text, its terms and its hashes are
made in that range without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvault.llm.common import settle

#: The band, as shares of all documents that have the term; a term of one document only is never in it.
LOW, HIGH = 0.002, 0.01
SUBSETS = 32
#: A subset's share of the lexicon, in 65536ths, by its tier: its number modulo 4.
SHARES = (8192, 2048, 512, 128)
#: Subsets of a tier that must have a term in either text for the tier to count.
LEAST = 2
#: Rows of a range, about.  There are MOST_RANGES at most, as there are tasks of a shuffle, so with very many documents a range has its share of them.
RANGE_ROWS = 500
MOST_RANGES = 50_000
#: An id with so many ranges' rows is dealt by its texts, into so many ranges at most.
HOT_RANGES, TEXT_RANGES = 8, 1024
#: Such ids whose bounds (8 KB each) are broadcast; more are joined by shuffling.
MOST_CUTS = 2_000
#: A lexicon over this size is joined by shuffling.  It holds at most (mean distinct terms a document) / LOW terms, however many documents there are.
BROADCAST_TERMS = 400_000
_NOT_TERM = "[^\\p{L}\\p{N}]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of letters and digits in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), _NOT_TERM), lambda t: t != ""))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term and marked (the term behind the number of each subset that has it) of the band's terms that some subset has, from the document frequencies over all of `docs`."""
    n = docs.count()
    each = docs.select(F.explode(terms(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term")).groupBy("term").count()
    band = each.filter((F.col("count") >= max(2.0, low * n)) & (F.col("count") <= max(2.0, high * n)))
    sha = F.sha2(F.col("term").cast("binary"), 256)
    digest = F.concat(sha, F.substring(sha, 1, 2))
    shares = f"array({', '.join(map(str, SHARES))})"
    own = f"transform(filter(sequence(0, {SUBSETS - 1}), k -> int(conv(substring(_digest, 2 * k + 1, 4), 16, 10)) < {shares}[k % {len(SHARES)}]), k -> concat(lpad(k, 2, '0'), ' ', term))"
    # settled here, as a filter on what follows would be tried on every term before the band is
    return settle(settle(band.select("term", digest.alias("_digest"))).select("term", F.expr(own).alias("marked"))).filter(F.size("marked") > 0)


def below(value: str, most: int) -> Column:
    """How many of the sorted `_bounds`, `most` at most, are under a value, by halving."""
    mid = "(c.a + c.b) div 2"
    step = f"if(c.a >= c.b, c, if(_bounds[int({mid})] < {value}, named_struct('a', {mid} + 1L, 'b', c.b), named_struct('a', c.a, 'b', {mid})))"
    return F.expr(f"aggregate(sequence(1, {most.bit_length() + 1}), named_struct('a', 0L, 'b', bigint(size(_bounds))), (c, i) -> {step}).a")


def ranged(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """_range, _rn, doc_id, text, _ghost and next_text: documents in falling order of id, with the text of the next one.

    The order is by doc_id, null last, then by text.  Ranges fall in the same order.  Rows of
    an id that very many rows share are dealt by the first bytes of their texts, so only those
    that begin alike share a task.  After its own rows each range holds a ghost, the first row
    of the next range that has any (of the last range: the very first row), so that what a
    range needs of its neighbour is there.
    """
    lowest = -(1 << 63)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(lowest))
    n = docs.count()
    pieces = min(MOST_RANGES, max(1, n // rows))
    # ids alone are sorted by range, and each range's greatest is a bound: a row a range, 8 bytes each
    tops_ = settle(base.select(key.alias("_id")).repartitionByRange(pieces, "_id").groupBy(F.spark_partition_id().alias("_part")).agg(F.max("_id").alias("_bound")).select("_bound").distinct())
    ranges = tops_.count()
    one = tops_.agg(F.sort_array(F.collect_list("_bound")).alias("b")).select(F.slice("b", 1, max(1, ranges - 1)).alias("b")) if ranges > 1 else None
    under = below("_id", ranges) if one is not None else F.lit(0)
    array = one.scalar() if one is not None else F.lit(None)
    dealt = base.withColumn("_id", key).withColumn("_bounds", array).withColumn("_range", F.lit(ranges) - under).drop("_bounds")
    # an id that many rows have, or none, is dealt into ranges of its texts, by their first bytes; it is the greatest of its range
    hot = settle(dealt.groupBy("_id").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HOT_RANGES * rows)) if n > HOT_RANGES * rows else None
    if hot is not None and not hot.isEmpty():
        head = F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
        headed = dealt.withColumn("_head", head)
        cuts = headed.join(hot, "_id", "left_semi").groupBy("_id").agg(F.percentile_approx("_head", [i / TEXT_RANGES for i in range(1, TEXT_RANGES)], 100 * TEXT_RANGES).alias("_bounds"))
        cuts = settle(cuts)
        dealt = headed.join(F.broadcast(cuts) if cuts.count() <= MOST_CUTS else cuts, "_id", "left").withColumn("_range", F.col("_range") * (4 * TEXT_RANGES) + F.when(F.col("_bounds").isNull(), 2 * TEXT_RANGES).otherwise(below("_head", TEXT_RANGES))).drop("_bounds", "_head")
    tops = settle(dealt.groupBy("_range").agg(F.max("_id").alias("_id")))
    # a row a range: the range before it, around the end
    order = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = tops.withColumn("_to", F.coalesce(F.lag("_range").over(Window.orderBy("_range")), F.max("_range").over(order)))
    ghosts = dealt.join(F.broadcast(before), ["_range", "_id"]).groupBy("_to").agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"), F.first("_id").alias("_id"))
    both = dealt.withColumn("_ghost", F.lit(0)).unionByName(ghosts.select("doc_id", "text", "_id", F.col("_to").alias("_range"), F.lit(1).alias("_ghost")))
    along = Window.partitionBy("_range").orderBy("_ghost", F.desc("_id"), "text")
    return both.select("_range", "doc_id", "text", "_ghost", F.row_number().over(along).alias("_rn"), F.lead("text").over(along).alias("next_text"))


def hashes(marked: Column) -> Column:
    """The hash of the marked terms of each subset, empty where a subset has none of them.

    Each subset's number and a sign sort before its terms, so one sorted list, joined and
    split at these, has the subsets' lists: linear in the terms, whatever the subsets.
    """
    heads = F.array(*[F.lit(f"{k:02}\x02") for k in range(SUBSETS)])
    lists = F.split(F.array_join(F.sort_array(F.concat(heads, marked)), " "), "[0-9]{2}\x02")
    return F.transform(F.slice(lists, 2, SUBSETS), lambda x: F.when(F.trim(x) == "", "").otherwise(F.substring(F.md5(F.trim(x).cast("binary")), 1, 12)))


def equals(a: Column, b: Column) -> Column:
    """For each subset of two fingerprints whether its hashes are equal; null where both have none."""
    return F.zip_with(F.split(a, "-"), F.split(b, "-"), lambda p, q: F.when((p == "") & (q == ""), None).otherwise(p == q))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """1 for equal fingerprints; else the greatest tier's share of equal hashes among the subsets that either fingerprint has, of tiers with LEAST of them; else that of all subsets."""

    def share(pairs: Column, least: int) -> Column:
        n = F.size(F.array_compact(pairs))
        return F.when(n >= least, F.size(F.array_remove(F.array_compact(pairs), False)) / F.greatest(n, F.lit(1)))

    def tier(t: int) -> Column:
        return F.array(*[F.get(equal, F.lit(k)) for k in range(t, SUBSETS, len(SHARES))])

    one_hash = (F.instr(a, "-") == 0) != (F.instr(b, "-") == 0)
    return F.when(a == b, 1.0).when(one_hash, 0.0).otherwise(F.coalesce(F.greatest(*[share(tier(t), LEAST) for t in range(len(SHARES))]), share(equal, 0)))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each row of `docs` and of its edited text, and how alike they and the next document's are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next.  The edited text is the text with its last third replaced by the beginning
    of the next document, in falling order of doc_id and after the last the first; of one
    document alone that is itself.  A fingerprint is the subsets' hashes joined by `-`; a
    text with no term in the lexicon's subsets has the one hash of all its sorted terms
    instead, and a text without terms (null or empty too) that of nothing.  Repeated rows
    come out as they are, next to each other; a null id is the last of all.  Other columns
    are ignored; an empty table gives no rows.
    """
    words = lexicon(docs, low, high)
    words = F.broadcast(words) if words.count() <= BROADCAST_TERMS else words
    third = F.expr("int(n_chars div 3)")
    lead = ranged(docs, rows).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.when(F.col("_ghost") == 0, F.concat(F.expr("substring(text, 1, int(n_chars) - int(n_chars div 3))"), F.substring(F.col("next_text"), F.lit(1), third)))
    both = lead.withColumn("edited", edited)
    own, other = terms(F.col("text")), terms(F.coalesce("edited", F.lit("")))

    def whole(array: Column) -> Column:
        return F.substring(F.md5(F.array_join(F.sort_array(array), " ").cast("binary")), 1, 12)

    made = both.select("_range", "_rn", "_ghost", "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), own.alias("own"), other.alias("other"))
    info = F.struct("_ghost", "doc_id", "n_chars", "sha", whole(F.col("own")).alias("own"), whole(F.col("other")).alias("other"))
    nothing = F.lit(None).cast("struct<_ghost: int, doc_id: bigint, n_chars: bigint, sha: string, own: string, other: string>")
    rows_ = made.select("_range", "_rn", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("own").alias("terms"), nothing.alias("info")),
        F.struct(F.lit(1).alias("side"), F.col("other").alias("terms"), nothing.alias("info")),
        F.struct(F.lit(2).alias("side"), F.array(F.lit("")).alias("terms"), info.alias("info")),
    )).alias("s")).select("_range", "_rn", "s.side", "s.info", F.explode("s.terms").alias("term"))
    hit = rows_.join(words, "term", "left").filter("marked is not null or side = 2")
    lists = hit.groupBy("_range", "_rn").agg(
        F.flatten(F.collect_list(F.when(F.col("side") == 0, F.col("marked")))).alias("a"), F.flatten(F.collect_list(F.when(F.col("side") == 1, F.col("marked")))).alias("b"),
        F.first("info", ignorenulls=True).alias("i"),
    )

    def print_of(kept: str, fallback: str) -> Column:
        return F.when(F.size(kept) > 0, F.array_join(hashes(F.col(kept)), "-")).otherwise(F.col(f"i.{fallback}"))

    printed = lists.select("_range", "_rn", "i", print_of("a", "own").alias("fingerprint"), print_of("b", "other").alias("edited_fingerprint"))
    along = Window.partitionBy("_range").orderBy("_rn")
    nexts = printed.withColumn("following", F.lead("fingerprint").over(along)).filter("i._ghost = 0")
    own, other, following = F.col("fingerprint"), F.col("edited_fingerprint"), F.col("following")
    compared = nexts.withColumn("_edited", equals(own, other)).withColumn("_next", equals(own, following))
    return compared.select(
        "i.doc_id", "i.n_chars", F.col("i.sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(own, other, F.col("_edited")).alias("near_edited"), likeness(own, following, F.col("_next")).alias("near_next"),
    )
