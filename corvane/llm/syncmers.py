"""Document fingerprints from closed syncmers, by Spark's own functions alone.

A text is a sequence of units: words, and each character of words of over UNIT characters (texts written without spaces,
long URLs). A k-mer is K units in a row,
its inner substrings are the runs of S units in it. It is a closed syncmer if the least hash among its inner substrings
stands first or last. Whether a k-mer is chosen depends on its own units alone, so an edit changes only the anchors
whose k-mers it touches, and equal passages carry equal anchors wherever they stand.

The fingerprint of a text is the sorted list of the SIZE least distinct hashes of its syncmers (fewer for short texts),
in hexadecimal digits, joined by commas. A text of fewer than K units has the hash of all its units as the only one; a
text without units has the empty fingerprint. The likeness of two fingerprints is the share of common hashes among the
SIZE least of their union, an estimate of the Jaccard similarity of the syncmer sets; two empty ones have likeness 1, an
empty and another one 0. Beside the hashes stand their places, the number of the unit at which each is first found, so
that fingerprints can also be matched by position: in_place counts the common anchors that stand at one place.

Null text counts as empty. A null doc_id counts as the least. Rows with equal doc_id follow each other by descending
text. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S, SIZE, UNIT = 5, 2, 128, 16


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<hash bigint, at int>>: hashes of the closed syncmers of text and the number of their first unit, in text order."""
    units = F.regexp_extract_all(text, F.lit(f"(?<!\\S)\\S{{1,{UNIT}}}(?!\\S)|\\S"), F.lit(0))
    inner = k - s

    def anchor(value: Column, at: Column) -> Column:
        return F.struct(value.alias("hash"), at.alias("at"))

    def chosen(h: Column) -> Column:
        def pick(m: Column) -> Column:
            def one(i: Column) -> Column:
                first, last = F.get(m, i), F.get(m, i + inner)
                least = F.least(*[F.get(m, i + j) for j in range(inner + 1)])
                middle = [F.get(h, i + j) for j in range(s, inner)]
                return F.when((first == least) | (last == least), anchor(F.xxhash64(first, last, *middle), i))

            return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(h) - k), one))

        runs = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)]))
        short = F.array(anchor(F.xxhash64(F.array_join(h.cast("array<string>"), ",")), F.lit(0)))
        return F.when(F.size(h) == 0, F.array().cast("array<struct<hash:bigint,at:int>>")).when(F.size(h) < k, short).otherwise(_let(runs, pick))

    return _let(F.transform(units, lambda u: F.xxhash64(u)), chosen)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Hashes of the closed syncmers of text, in text order."""
    return placed(text, k, s).getField("hash")


def least(text: Column, size: int = SIZE) -> Column:
    """As placed(): the anchors with the least hashes, each where it stands first, sorted by hash."""
    return _let(F.sort_array(placed(F.coalesce(text, F.lit("")))), lambda s: F.slice(F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1).getField("hash") != x.getField("hash"))), 1, size))


def fingerprint(text: Column, size: int = SIZE) -> Column:
    """array<bigint>: the least hashes, sorted."""
    return least(text, size).getField("hash")


def in_place(a: Column, at_a: Column, b: Column, at_b: Column) -> Column:
    """How many hashes two fingerprints have in common that stand at the same unit in both texts."""

    def both(hashes: Column, places: Column) -> Column:
        return F.zip_with(hashes, places, lambda h, p: F.xxhash64(h, p))

    return F.size(F.array_intersect(both(a, at_a), both(b, at_b))).cast("long")


def shown(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def listed(places: Column) -> Column:
    return F.array_join(places.cast("array<string>"), ",")


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union)).cast("double")


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (id: long without nulls, ...) with next_<c> for columns: of the next row by descending id, and after the last of the first.

    Ids are cut into as many ranges as a few for each shuffle partition, at quantiles. The greatest id of each range is
    offered to the range above it as well, so one window over each range finds every neighbour, and each row crosses
    one shuffle. Only ids of range bounds (a parameter's number of them) come to the driver.
    """
    spark = df.sparkSession
    ranges = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(c) for c in df.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    span = F.lit(0)
    if cuts:
        # The number of cuts at or below the id, by a binary search over a literal array.
        edges = F.array(*[F.lit(c) for c in cuts])
        span = _bisect(edges, F.col("id"), len(cuts))
    df = df.withColumn("_span", span.cast("int"))
    heads = sorted((r["_span"], r["head"]) for r in df.groupBy("_span").agg(F.max("id").alias("head")).collect())
    ghosts = [(heads[i][1], heads[(i + 1) % len(heads)][0]) for i in range(len(heads))]
    offered = spark.createDataFrame(ghosts, "id long, _above int")
    df = df.join(F.broadcast(offered), "id", "left")
    own = F.struct(F.col("_span").alias("at"), F.lit(0).alias("ghost"))
    up = F.struct(F.col("_above").alias("at"), F.lit(1).alias("ghost"))
    df = df.withColumn("_to", F.explode(F.when(F.col("_above").isNull(), F.array(own)).otherwise(F.array(own, up))))
    order = Window.partitionBy("_to.at").orderBy(F.col("_to.ghost"), F.desc("id"), *[F.desc(c) for c in columns[:1]])
    out = df.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return out.where("_to.ghost = 0").drop("_span", "_above", "_to")


def _bisect(edges: Column, value: Column, n: int) -> Column:
    """How many of the n sorted edges are at or below value."""

    def further(step: int):
        return lambda x: F.when((x + step <= n) & (F.get(edges, x + (step - 1)) <= value), x + step).otherwise(x)

    low, step = F.lit(0), 1 << max(0, n.bit_length() - 1)
    while step:
        # Each step is bound to a variable, so the expression grows with the number of steps only.
        low = _let(low, further(step))
        step >>= 1
    return low


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, places, edited_places,
    in_place for each row of docs.

    The edited text is text with its last floor(n_chars / 2) code points replaced by the first as many of the next text.
    """
    lowest = -(1 << 63)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"), text.alias("text"))
    first = own.withColumn("found", least(F.col("text")))
    first = first.select("doc_id", "id", "text", F.col("found.hash").alias("hashes"), F.col("found.at").alias("places"))
    both = with_next(first, ["text", "hashes"])
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    changed = both.withColumns({"n_chars": n, "edited": F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))})
    changed = changed.withColumn("found", least(F.col("edited")))
    changed = changed.withColumns({"edited_hashes": F.col("found.hash"), "edited_places": F.col("found.at")})
    return changed.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown(F.col("hashes")).alias("fingerprint"),
        shown(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
        listed(F.col("places")).alias("places"),
        listed(F.col("edited_places")).alias("edited_places"),
        in_place(F.col("hashes"), F.col("places"), F.col("edited_hashes"), F.col("edited_places")).alias("in_place"),
    )
