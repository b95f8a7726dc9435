"""Document fingerprints by SimHash, with DataFrame functions only.

Each word of a text votes with its weight on each of 128 signed bits, by the bits of its hash: short words,
which are in nearly every text, weigh little, and a word that occurs n times votes n times. Votes are summed
in lanes: one long holds the counts of four bits, so 32 sums make the 128 counts. A chunk of CHUNK words is
summed at a time, which keeps a lane below 2^15; chunks then add up unpacked, so no text is too long.

`near` finds all pairs of fingerprints within a Hamming radius r from permuted block tables: 128 bits are cut
into BLOCKS blocks, and two fingerprints that differ in at most r bits agree on BLOCKS - r blocks at least, so
there is a table for each choice of that many blocks, keyed by their bits. The query counts by it the near
documents of every document whose id is divisible by 20.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, words

BITS, CHUNK, BLOCKS, RADIUS = 128, 4000, 8, 6
LANES = 0x0001000100010001
#: Fingerprints of one key and table from which on they are dealt to cells.
BUCKET = 1024


def weight(word: Column) -> Column:
    """0 to 8: a word's length beyond three characters; words of up to three weigh nothing beside longer ones."""
    return F.least(F.greatest(F.length(word) - 3, F.lit(0)), F.lit(7)).cast("long") + F.when(F.length(word) > 0, F.lit(1)).otherwise(F.lit(0))


def fingerprints(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """key and fingerprint, 32 hexadecimal digits, for each row of texts.

    Key columns tell rows apart; if texts are already partitioned by some of them, nothing is shuffled.
    Texts without words, null among them, have all votes at zero and the fingerprint of 32 zeros.
    """
    said = texts.select(*key, F.posexplode_outer(words(F.col(text))).alias("_at", "_word"))
    said = said.withColumn("_w", F.coalesce(weight(F.col("_word")), F.lit(0).cast("long")))
    said = said.withColumn("_h0", F.xxhash64("_word")).withColumn("_h1", F.xxhash64("_word", F.lit(1)))
    lanes = [
        F.sum(F.shiftrightunsigned(f"_h{h}", k).bitwiseAND(F.lit(LANES)) * F.col("_w")).alias(f"_s{16 * h + k}")
        for h in range(2) for k in range(16)
    ]
    chunks = said.groupBy(*key, F.floor(F.coalesce("_at", F.lit(0)) / CHUNK).alias("_chunk")).agg(F.sum("_w").alias("_all"), *lanes)
    # bit 64 h + 16 lane + k has its count in lane `lane` of sum 16 h + k
    counts = [F.sum(F.shiftrightunsigned(f"_s{16 * (b // 64) + b % 16}", 16 * (b % 64 // 16)).bitwiseAND(F.lit(0xFFFF))).alias(f"_b{b}") for b in range(BITS)]
    voted = chunks.groupBy(*key).agg(F.sum("_all").alias("_all"), *counts)

    def half(h: int) -> Column:
        bits = [F.when(F.col(f"_b{64 * h + i}") * 2 > F.col("_all"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(64)]
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
        return F.lpad(F.lower(F.hex(bits[0])), 16, "0")

    return voted.select(*key, F.concat(half(1), half(0)).alias("fingerprint"))


def _half(fingerprint: Column, at: int) -> Column:
    """64 bits of a fingerprint as a long. conv() gives an unsigned decimal, so each half is put together of two."""
    word = lambda i: F.conv(F.substring(fingerprint, 16 * at + 8 * i + 1, 8), 16, 10).cast("long")
    return F.shiftleft(word(0), 32).bitwiseOR(word(1))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    return F.bit_count(_half(a, 0).bitwiseXOR(_half(b, 0))) + F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1.0 - distance(a, b) / float(BITS)


def with_block(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """docs with _block: consecutive ranges of `order` with about as many rows each, four for each shuffle
    partition; nulls come first. Only the bounds of the ranges, whose number the session sets, reach the driver."""
    n = 4 * shuffle_partitions(docs.sparkSession)
    bounds = sorted(set(docs.approxQuantile(order, [i / n for i in range(1, n)], 1 / (4 * n))))
    side = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    if not rows:
        return docs.withColumn("_block", F.lit(0))
    value = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    # two short scans find the bound: over the first bound of each row of them, then over that row
    row = F.size(F.filter(F.array(*[F.lit(r[0]) for r in rows]), lambda b: b <= value))
    table = F.array(*[F.array(*map(F.lit, r)) for r in rows])
    inside = F.size(F.filter(F.element_at(table, F.greatest(row, F.lit(1))), lambda b: b <= value))
    return docs.withColumn("_block", F.when(row == 0, F.lit(0)).otherwise((row - 1) * side + inside))


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text of the next document by (doc_id, text) with _block, _row and _spare; after the
    last comes the first, and nulls are before all. Null texts are empty.

    Rows move once, to their block. A block's first document is also sent to the block before as a spare row
    (_spare = 1) behind the others, so no other block is looked at.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_block(own).withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    firsts = sorted((r[0], r[1]) for r in own.groupBy("_block").agg(F.min("_id")).collect())  # one row for each block
    heads = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = spark.createDataFrame(heads, "_id long, _to int")
    spare = own.join(F.broadcast(heads), "_id").select("doc_id", "text", F.col("_to").alias("_block"), "_id", F.lit(1).alias("_spare"))
    order = Window.partitionBy("_block").orderBy("_spare", "_id", "text")
    rows = own.withColumn("_spare", F.lit(0)).unionByName(spare)
    return rows.withColumn("_row", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).drop("_id")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each document: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of the next
    document, or by all if it has fewer. near_* are likenesses of the document's fingerprint to that of the
    edited text and of the next document. Null texts count as empty; a single document is its own next one;
    rows that repeat stay; other columns of docs are not looked at.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = followed(docs).select("_block", "_row", "_spare", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("_edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256))
    key = ["_block", "_row", "_spare", "doc_id", "n_chars", "edited_sha256"]
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("said")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("said"))))
    found = fingerprints(rows.select(*key, both.alias("_v")).select(*key, F.col("_v.kind").alias("_kind"), F.col("_v.said").alias("_said")), [*key, "_kind"], "_said")
    of = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("fingerprint")))
    wide = found.groupBy(*key).agg(of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"))
    wide = wide.withColumn("_following", F.lead("fingerprint").over(Window.partitionBy("_block").orderBy("_row"))).where("_spare = 0")
    return wide.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_following")).alias("near_next"),
    )


def _tables(df: DataFrame, radius: int, blocks: int) -> DataFrame:
    """_hi, _lo of each distinct fingerprint with _table and _key, once for each choice of blocks."""
    width = BITS // blocks
    mask = (1 << width) - 1
    part = lambda i: F.shiftrightunsigned("_hi" if i < blocks // 2 else "_lo", width * (blocks // 2 - 1 - i % (blocks // 2))).bitwiseAND(F.lit(mask))
    keys = F.array(*[F.xxhash64(*map(part, c)) for c in combinations(range(blocks), blocks - radius)])
    own = df.select("fingerprint").where(F.col("fingerprint").isNotNull()).distinct()
    return own.select(_half(F.col("fingerprint"), 0).alias("_hi"), _half(F.col("fingerprint"), 1).alias("_lo")).select("_hi", "_lo", F.posexplode(keys).alias("_table", "_key"))


def near(found: DataFrame, queries: DataFrame | None = None, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (fingerprint, near_fingerprint, distance) of distinct fingerprints within the radius: all unordered
    pairs of `found`, or those of a stated query set against all of `found`.

    Radius is less than `blocks`, which is 4, 8 or 16. Equal fingerprints are one; null ones take no part.

    Fingerprints that share no key with a query are left out before anything is paired. A key that more than BUCKET
    of the others have is dealt to cells of about that many, which its queries are sent to, so a large group of near
    copies is no task's alone. A pair that several tables find is given by the first of them.
    """
    width, need = BITS // blocks, blocks - radius
    asked, key = _tables(found if queries is None else queries, radius, blocks), ["_table", "_key"]
    met = _tables(found, radius, blocks)
    if queries is not None:
        met = met.join(asked.select(*key), key, "left_semi")
    met = materialize(met)
    cells = met.groupBy(*key).agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("_cells"))
    dealt = met.join(cells.where("_cells > 1"), key, "left").withColumn("_cell", F.coalesce(F.pmod(F.xxhash64("_hi", "_lo"), F.col("_cells")), F.lit(0)).cast("int"))
    sent = asked.join(cells, key).select(*key, F.col("_hi").alias("_qhi"), F.col("_lo").alias("_qlo"), F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("_cell"))
    high, low = F.col("_hi").bitwiseXOR(F.col("_qhi")), F.col("_lo").bitwiseXOR(F.col("_qlo"))
    whole = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    pairs = sent.join(dealt.drop("_cells"), [*key, "_cell"]).withColumn("distance", F.bit_count(high) + F.bit_count(low)).where(F.col("distance").between(1, radius))
    agree = [F.shiftrightunsigned(x, width * i).bitwiseAND(F.lit((1 << width) - 1)) == 0 for x in (high, low) for i in reversed(range(blocks // 2))]
    first = F.slice(F.filter(F.array(*[F.when(a, F.lit(i)) for i, a in enumerate(agree)]), F.isnotnull), 1, need)
    choice = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(blocks), need)]), F.col("_table") + 1)
    pairs = pairs.where(first == choice).select(whole("_qhi", "_qlo").alias("fingerprint"), whole("_hi", "_lo").alias("near_fingerprint"), "distance")
    return pairs if queries is not None else pairs.where("fingerprint < near_fingerprint")


def near_counts(found: DataFrame, every: int = 20, radius: int = RADIUS) -> DataFrame:
    """found with n_near: for rows whose doc_id is divisible by `every`, the number of other rows whose fingerprint is
    within the radius, equal ones among them; null for the others. found has doc_id and fingerprint, and is read often."""
    asked = F.coalesce((F.col("doc_id") % every == 0) & F.col("fingerprint").isNotNull(), F.lit(False))
    queries = found.where(asked).select("fingerprint")
    times = found.groupBy("fingerprint").agg(F.count("*").alias("_times"))
    links = near(found, queries, radius).join(times.withColumnRenamed("fingerprint", "near_fingerprint"), "near_fingerprint")
    links = links.groupBy("fingerprint").agg(F.sum("_times").alias("_links"))
    counted = times.join(queries.distinct(), "fingerprint").join(links, "fingerprint", "left")
    counted = counted.select("fingerprint", (F.col("_times") - 1 + F.coalesce("_links", F.lit(0))).alias("n_near"))
    # rows that ask nothing meet nothing: as null keys they would all be one task's
    own = found.where(asked).join(counted, "fingerprint", "left").select(*found.columns, "n_near")
    return own.unionByName(found.where(~asked).withColumn("n_near", F.lit(None).cast("long")))
