"""Document fingerprints: bottom-k sketches of 5-word shingle hashes, in DataFrame functions only.

A text's sketch is the K smallest distinct hashes of its shingles, ascending. Sketches of
parts merge by keeping the K smallest of their union. From two sketches the resemblance
(Jaccard), containment and the distinct shingle counts are estimated.

Words are runs of anything but ASCII white space, in lower case (A-Z). A text of fewer words
than a shingle has its whole sequence as one shingle; a null or wordless text has an
empty sketch, written ''. Two empty sketches are alike (1.0); an empty and another are not.
Equal texts have equal sketches, so ties and repeats are harmless. Rows of one doc_id follow
each other by the hash of their text; those without a doc_id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.runtime import cut, partitions

SHINGLE = 5
K = 64
RANGE_CHARS = 32 << 20  # about the text of one range of doc_id in the order of documents
LAST = 2**63 - 1
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOP = 2.0**63


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes (non-negative 63 bits), ascending."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    words = F.filter(F.split(low, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(_shingles(hashed, n))), 1, k)


def _shingles(hashed: Column, n: int) -> Column:
    """Hashes of each n consecutive entries; of all of them, if there are fewer but some."""

    def all_of(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - n)
        one = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]).bitwiseAND(F.lit(2**63 - 1))
        return (
            F.when(F.size(h) >= n, F.transform(places, one))
            .when(F.size(h) > 0, F.array(F.xxhash64(h).bitwiseAND(F.lit(2**63 - 1))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    # A lambda over a one-entry array evaluates the hashes once for all uses.
    return F.get(F.transform(F.array(hashed), all_of), 0)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's k smallest that both have."""
    both = merge(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)
    )


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(_TOP) / F.get(a, F.lit(k - 1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    share = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k)) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def written(a: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """docs with `low`, the least doc_id of the range that a row is in: `ranges` of them or up to twice as many.

    Ranges share all bits of doc_id but the lowest ones. One with too many rows is parted
    again by lower bits, so ids may lie anywhere; a doc_id of many rows stays in one range.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    least, most, n = ids.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    shift = 0
    while n and (most >> shift) - (least >> shift) >= 2 * ranges:
        shift += 1
    floor = lambda s: F.expr(f"shiftleft(shiftright(doc_id, {s}), {s})")
    part = lambda table: table.withColumn("low", floor(shift))
    placed, ids = part(docs), part(ids)
    while shift > 0:
        full = ids.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") > max(1, 4 * n // ranges)).select(F.col("low").alias("full"))
        full = cut(full, "full")  # ranges / 4 rows at most
        if full.isEmpty():
            break
        shift = max(0, shift - 6)
        again = lambda table: table.join(F.broadcast(full), F.col("low") == F.col("full"), "left").withColumn("low", F.when(F.col("full").isNull(), F.col("low")).otherwise(floor(shift))).drop("full")  # noqa: E731, B023
        placed, ids = again(placed), again(ids)
    return placed.withColumn("low", F.coalesce("low", F.lit(LAST)))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs(doc_id, text, sketch) with the next document's next_text and next_sketch, in the order of documents.

    The first follows the last. Documents are dealt into ranges of doc_id (of their texts'
    hashes, where there is none); the text is shuffled once. A range's last document is
    followed by the first of the next range, so each range's first document is also sent to
    the range before it; those are one small table with a row for each range.
    """
    bits = (4 * ranges - 1).bit_length()
    own = (
        _in_ranges(docs, 4 * ranges)  # several for each task, so that tasks are even
        .withColumn("unnamed", F.col("doc_id").isNull())
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("part", F.struct("low", F.when(F.col("unnamed"), F.shiftright("tie", 64 - bits)).otherwise(F.lit(-LAST)).alias("sub")))
    )
    place = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("order"), F.col("unnamed"), F.col("tie"))
    own = own.select(*docs.columns, "part", place.alias("place"))
    firsts = cut(own.groupBy("part").agg(F.min("place").alias("first")), "firsts")  # a row for each range
    in_order = Window.orderBy("part")
    last = firsts.agg(F.max("part")).first()[0]
    last = F.struct(F.lit(last.low).cast("long").alias("low"), F.lit(last.sub).cast("long").alias("sub")) if last else F.col("part")
    before = firsts.select("first", F.coalesce(F.lag("part").over(in_order), last).alias("to"))
    sent = own.join(F.broadcast(before), F.col("place") == F.col("first"), "left")
    homes = F.array(F.struct("part", F.lit(False).alias("guest")))
    homes = F.when(F.col("to").isNull(), homes).otherwise(F.array_append(homes, F.struct(F.col("to").alias("part"), F.lit(True).alias("guest"))))
    dealt = sent.withColumn("home", F.explode(homes)).select("home.*", *docs.columns, "place").repartition(ranges, "part")
    # Rows that repeat a range's first one are guests, too: the least of them follows its last row.
    window = Window.partitionBy("part").orderBy("guest", "place")
    return dealt.withColumn("next_text", F.lead("text").over(window)).withColumn("next_sketch", F.lead("sketch").over(window)).where("not guest").drop("part", "guest", "place")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The contract's rows for docs(doc_id, text): fingerprints of each text and of its edited form."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = max(partitions(docs.sparkSession), -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // RANGE_CHARS))
    pairs = with_next(texts.withColumn("sketch", sketch(F.col("text"))), ranges)
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))"))
    both = pairs.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"),
    )
