"""Document fingerprints by closed syncmers of words. SQL functions only.

A k-mer of words is a closed syncmer if the least of its inner s-mers lies at its beginning or its end. Whether it
is one depends on its own words alone, so equal passages have equal anchors wherever they stand, and two anchors
that match say by how much the passages are shifted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import block_count, free_name

WORDS, INNER = 5, 2
#: Text bytes in one range of ids, within which a document's successor is found.
RANGE_BYTES = 4 << 20
#: So many ranges at most, as their bounds are part of the plan; beyond 80 GB ranges are larger.
MOST_RANGES = 20_000
_WHITE = r"[\x20\x09-\x0D]+"


def with_anchors(docs: DataFrame, words: int = WORDS, inner: int = INNER) -> DataFrame:
    """``docs`` (with ``text``) and ``anchors``: an array of ``struct<at int, hash long>``, the closed syncmers in order.

    ``at`` counts words from nought. A text of fewer than ``words`` words has one anchor, of all its words, and a
    text without words, or null, has none. Ties of inner s-mers count as least wherever they stand.
    """
    width = words - inner + 1
    words_ = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _WHITE), lambda w: w != "")
    own = free_name(docs, "_w")
    inner_ = free_name(docs, "_s")
    rows = docs.withColumn(own, F.transform(words_, lambda w: F.xxhash64(w)))
    pairs = F.col(own)
    for i in range(1, inner):
        shifted = F.slice(own, i + 1, F.greatest(F.size(own) - i, F.lit(0)))
        pairs = F.zip_with(F.slice(pairs, 1, F.greatest(F.size(shifted), F.lit(0))), shifted, lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn(inner_, pairs)
    places = F.when(F.size(own) >= words, F.sequence(F.lit(0), F.size(own) - words)).otherwise(F.array().cast("array<int>"))
    first, last = lambda i: F.get(inner_, i), lambda i: F.get(inner_, i + width - 1)
    edge = lambda i: F.array_min(F.slice(inner_, i + 1, width)) == F.least(first(i), last(i))
    hashed = lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(words)])
    found = F.transform(F.filter(places, edge), lambda i: F.struct(i.alias("at"), hashed(i).alias("hash")))
    short = F.when(F.size(own) > 0, F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.array_join(F.transform(own, lambda h: F.hex(h)), ",")).alias("hash")))).otherwise(F.array().cast("array<struct<at:int,hash:bigint>>"))
    return rows.withColumn("anchors", F.when(F.size(own) >= words, found).otherwise(short)).drop(own, inner_)


def hash_set(anchors: Column) -> Column:
    """All distinct hashes, cut to 32 bits, as ascending array of long."""
    return F.sort_array(F.array_distinct(F.transform(anchors, lambda a: F.shiftrightunsigned(a["hash"], 32))))


def as_text(hashes: Column) -> Column:
    """Eight hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard likeness of two sets of hashes; two empty ones are alike (1), an empty and another are not (0)."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1)))


def shared_passages(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_id, right_id, shift, n_anchors, first, last`` for the anchors of texts of ``right`` that stand in ``left`` too, by their shift.

    Both have ``doc_id`` and ``text``. An anchor of the right text is matched with its first place in ``left``, in the
    text of the least id that has it; so there are no more matches than anchors, however many texts share a passage,
    and those that do name the same text. ``shift`` is the place in the right text less that in the left one, ``first``
    and ``last`` the least and greatest place in the left one. Repeated rows of ``right`` count as often; null texts
    have no anchors, null ids of ``left`` come after all others, and empty tables give no rows.
    """

    def spread(docs: DataFrame, side: str) -> DataFrame:
        rows = with_anchors(docs.select(F.col("doc_id").alias(f"{side}_id"), "text"))
        return rows.select(f"{side}_id", F.explode("anchors").alias("_a")).select(f"{side}_id", F.col("_a.at").alias(f"_{side}"), F.col("_a.hash").alias("_hash"))

    place = F.struct(F.col("left_id").isNull().alias("_none"), "left_id", "_left")
    firsts = spread(left, "left").groupBy("_hash").agg(F.min(place).alias("_f")).select("_hash", "_f.left_id", "_f._left")
    pairs = spread(right, "right").join(firsts, "_hash")
    return pairs.groupBy("left_id", "right_id", (F.col("_right") - F.col("_left")).alias("shift")).agg(
        F.count(F.lit(1)).alias("n_anchors"), F.min("_left").alias("first"), F.max("_left").alias("last")
    )


def _rank(key: Column, bounds: Column, n: int) -> Column:
    """How many of ``n`` ascending bounds are not above ``key``, by halving."""
    begin = F.struct(F.lit(0).alias("low"), F.lit(n).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        above = (state["low"] >= state["high"]) | (F.get(bounds, F.least(middle, F.lit(n - 1))) > key)
        return F.struct(F.when(above, state["low"]).otherwise(middle + 1).alias("low"), F.when(above, F.greatest(state["low"], middle)).otherwise(state["high"]).alias("high"))

    return F.aggregate(F.array(*[F.lit(0)] * (n.bit_length() + 1)), begin, halve)["low"]


def with_successor(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` and ``next``: a struct of ``columns`` of the row with the next ``doc_id``, after the last that of the first.

    Ids are cut into ranges at some of the ids themselves, so that no range is empty; the first row of each range
    also stands, as a copy, at the end of the range before, and every row finds its successor within its range.
    Equal ids go by text; null ids come last. An only row follows itself; an empty table gives an empty one.
    """
    ranges = min(block_count(docs, RANGE_BYTES), MOST_RANGES)
    key = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    at = F.lit([i / ranges for i in range(ranges)])
    bounds = docs.agg(F.array_sort(F.array_distinct(F.percentile_approx(key, at, F.lit(10_000 + 20 * ranges)))).alias("b"), F.min(key).alias("m")).first()
    cuts = sorted({bounds["m"], *bounds["b"]}) if bounds["m"] is not None else [0]
    n = len(cuts)
    rows = docs.withColumn("_key", key).withColumn("_range", _rank(F.col("_key"), F.lit(cuts), n) - 1)
    own, copy = F.struct(F.col("_range").alias("range"), F.lit(False).alias("copy")), F.struct(F.pmod(F.col("_range") - 1, F.lit(n)).alias("range"), F.lit(True).alias("copy"))
    rows = rows.withColumn("_spot", F.explode(F.when(F.get(F.lit(cuts), F.col("_range")) == F.col("_key"), F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy("_spot.range").orderBy("_spot.copy", "_key", "text")
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter("not _spot.copy").drop("_key", "_range", "_spot")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row of ``docs``.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or all, of
    the next document's text. A fingerprint holds all distinct anchors of its text. Null texts count as empty; equal
    texts have equal fingerprints; an empty text has an empty one. Repeated rows follow each other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_successor(rows, ["text"]).withColumn("_n", F.char_length("text"))
    half = F.expr("_n div 2").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("_n") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", F.col("_n").cast("long").alias("n_chars"), "text", edited.alias("_edit"), F.col("next.text").alias("_following"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edit").cast("binary"), 256))
    for source, name in (("text", "_print"), ("_edit", "_edited"), ("_following", "_next")):  # anchors anew: they are larger to send than the text
        rows = with_anchors(rows.withColumn("text", F.col(source))).withColumn(name, hash_set(F.col("anchors"))).drop("anchors")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_print")).alias("fingerprint"), as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_edited")).alias("near_edited"), likeness(F.col("_print"), F.col("_next")).alias("near_next"),
    )
