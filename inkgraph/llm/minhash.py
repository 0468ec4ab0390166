"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

DataFrame functions only. A document's word shingles are hashed once. The hash's top bits name a bin, each bin keeps
its least hash. An empty bin takes the value of the bin that comes first in the bin's own random order of all bins,
whichever of them are filled, so that two documents draw alike. Of every value four bits remain, a hex digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.llm.shared import let

SHINGLE = 5
#: Bins, as a power of two, and bits kept of each.
BIN_BITS, KEPT_BITS = 7, 4
BINS = 1 << BIN_BITS
NONE = "0" * BINS
#: Ranges of ids are found in two steps of so many limits each.
WIDTH = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(words: Column, size: int) -> Column:
    """Hashes of the shingles: each of its words' hashes in turn; of all the words, where they are fewer."""

    def over(h: Column) -> Column:
        hash_at = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size)))
        last = F.greatest(F.size(h) - size, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), hash_at)

    return let(F.transform(words, lambda w: F.xxhash64(w)), over)


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """BINS hex digits of each whole text; null and wordless texts have NONE.

    Words are those between ASCII white space, A-Z lower-cased."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def name(h: Column) -> Column:
        # in the order of signed longs
        return F.shiftright(h, 64 - BIN_BITS) + BINS // 2

    def firsts(h: Column) -> Column:
        # sorted as signed longs, a bin's hashes stay together and in order
        return F.filter(h, lambda x, i: (i == 0) | (name(x) != name(F.get(h, i - 1))))

    def digits(mins: Column) -> Column:
        named = F.map_from_arrays(F.transform(mins, lambda x: name(x).cast("int")), mins)

        def fill(table: Column) -> Column:
            def at(b: Column) -> Column:
                # the order of bin b: least hash of (b, donor) first; what is taken is hashed with b, so that bins
                # of one donor agree by chance independently
                donor = F.array_min(F.transform(mins, lambda x: F.struct(F.xxhash64(b, name(x).cast("int")).alias("turn"), x.alias("least"))))["least"]
                return F.coalesce(F.get(table, b), F.xxhash64(donor, b))

            return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), at)

        full = F.size(mins) == BINS
        table = let(named, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(m, b)))
        low = F.when(full, mins).otherwise(let(table, fill))
        return F.array_join(F.transform(low, lambda x: F.lower(F.hex(x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1))))), "")

    def whole(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.lit(NONE)).otherwise(let(let(F.sort_array(_shingles(w, size)), firsts), digits))

    return let(words, whole)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness (0 to 1) of two fingerprints: the share of equal digits, less what chance makes
    equal. Wordless texts are like each other, and unlike all else."""
    equal = F.aggregate(F.sequence(F.lit(1), F.lit(BINS)), F.lit(0), lambda n, i: n + (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))).cast("int"))
    chance = 1.0 / (1 << KEPT_BITS)
    corrected = F.greatest((equal / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    return F.when(a == b, 1.0).when((a == NONE) | (b == NONE), 0.0).otherwise(corrected)


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out_col``; repeated rows stay, an empty table gives none."""
    return docs.withColumn(out_col, fingerprint(F.col(text_col)))


def with_next(docs: DataFrame, id_col: str, carried: list[str], bucket: int = 2000) -> DataFrame:
    """``docs`` with next_<c> for each carried column: that of the next row in falling order of ids, after the last
    the first. Rows that repeat an id follow each other by the carried columns; rows without an id come last.

    Ids are cut into ranges of about ``bucket`` rows (at most WIDTH ** 2 ranges), which are ordered each on its own
    with a copy of the row that follows the range. Only the limits of the ranges come to the driver.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = docs.withColumn("_key", key)
    n = rows.count()
    wanted = max(1, min(WIDTH * WIDTH, n // bucket))
    limits = rows.agg(F.percentile_approx("_key", F.array(*[F.lit((i + 1) / wanted) for i in range(wanted - 1)]), F.lit(20 * wanted))).first()[0] if wanted > 1 else []
    limits = sorted(set(limits or []))
    coarse = limits[WIDTH - 1 :: WIDTH]
    fine = [limits[i : i + WIDTH - 1] for i in range(0, len(limits) or 1, WIDTH)]

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b < F.col("_key")))

    def literal(values: list) -> Column:
        return F.lit(values) if values else F.array().cast("array<bigint>")

    first = below(literal(coarse))
    # a range ends at its limit, itself included
    second = below(F.get(F.array(*map(literal, fine)), first))
    rows = rows.withColumn("_bucket", first * WIDTH + second)
    tops = sorted((r[0], r[1]) for r in rows.groupBy("_bucket").agg(F.max("_key")).collect())
    follow = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    follow = F.broadcast(docs.sparkSession.createDataFrame(follow, "_top long, _to int"))
    own, copy = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("extra")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("extra"))
    rows = rows.join(follow, F.col("_key") == F.col("_top"), "left")
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    order = Window.partitionBy("_at.b").orderBy("_at.extra", F.desc("_key"), *carried)
    rows = rows.withColumn("_next", F.lead(F.struct(*carried)).over(order)).where("_at.extra = 0")
    rows = rows.withColumns({f"next_{c}": F.col(f"_next.{c}") for c in carried})
    return rows.drop("_key", "_bucket", "_top", "_to", "_at", "_next")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the next document's beginning in place of its own second half. Null texts are empty ones;
    a table of one row is its own next. Repeated rows stay, other columns are not looked at."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("fingerprint", fingerprint(F.col("text"))), "doc_id", ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    near = lambda other: likeness(F.col("fingerprint"), F.col(other))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("next_fingerprint").alias("near_next"))
