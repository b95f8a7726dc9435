"""Line dedup by content-defined line chunks, with DataFrame functions only.

A text is a list of lines. A rolling hash over the hashes of two neighbouring lines ends a chunk where it is
divisible by SPREAD, unless a chunk of one line would come of it, and lines that are put in or taken out upstream
shift no later boundary but the next. A chunk that occurs more than once in the corpus keeps its first
place, by (doc_id, line); elsewhere its lines go, but only after the bytes have been compared. A text of one line
has no chunk.

Chunk hashes, not texts, are what is counted. Texts move twice: to their repeated chunks, and to the verdicts.
Counts are summed before the shuffle, and the joins on a chunk's hash are plain equi-joins between shuffled
tables, whose hot partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, set_aside, taken_back

#: SPREAD counts boundaries before those that follow another are skipped.
SPREAD, BASE, MODULUS = 2, 1_000_003, 2_147_483_647


def lines(text: Column) -> Column:
    """Lines of a text without their ends; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    """32 bits of a line's MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_starts(ls: str, hs: str) -> Column:
    """Indexes, from 1, of the lines of column ls that start a chunk; hs holds their hashes.

    No chunk of a text of two lines or more is a single line, as a boundary right behind another or
    before the last line is none. That looks at no line but the four around it.
    """
    before = lambda i: F.element_at(hs, i)
    rolled = lambda i: F.pmod(F.pmod(before(i - 2) * BASE, F.lit(MODULUS)) + before(i - 1), F.lit(MODULUS))
    ends = lambda i: F.when(i == 1, F.lit(True)).when(i == 2, F.lit(False)).otherwise(rolled(i) % SPREAD == 0)
    # i - 1 is 2 at least where ends(i - 1) matters
    apart = lambda i: (i == 1) | (ends(i) & (i < F.size(ls)) & ((i == 3) | ~ends(F.greatest(i - 1, F.lit(1)))))
    return F.filter(F.sequence(F.lit(1), F.size(ls)), apart)


def keyed(docs: DataFrame) -> DataFrame:
    """_key, which stands for doc_id and text, doc_id and _ls, the lines of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64(text).alias("_key"), F.col("doc_id").cast("long").alias("doc_id"), lines(F.col("text")).alias("_ls"))


def said(start: Column, n: Column) -> Column:
    """The bytes of n lines of _ls."""
    return F.array_join(F.slice("_ls", start, n), "\n")


def digest(text: Column) -> Column:
    """128 bits of a chunk's bytes."""
    return F.unhex(F.md5(text))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, _key, _start (line, from 1), _n (lines), _hash of every chunk of two lines or more."""
    own = keyed(docs).where(F.size("_ls") > 1)
    own = own.withColumn("_hs", F.transform("_ls", line_hash)).withColumn("_at", chunk_starts("_ls", "_hs"))
    own = own.withColumn("_end", F.concat(F.slice("_at", 2, F.size("_at")), F.array(F.size("_ls") + 1)))
    # digests are taken before chunks become rows, so that no row holds more than its own chunk's
    place = lambda s, e: F.struct(s.alias("s"), (e - s).alias("n"), digest(said(s, e - s)).alias("h"))
    each = own.select("doc_id", "_key", F.explode(F.filter(F.zip_with("_at", "_end", lambda s, e: F.when(e - s > 1, place(s, e))), F.isnotnull)).alias("_c"))
    return each.select("doc_id", "_key", F.col("_c.s").alias("_start"), F.col("_c.n").alias("_n"), F.col("_c.h").alias("_hash"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _key and _gone, array of (start, n): the lines that go from each document that loses any."""
    found = chunks(docs)
    counted = found.groupBy("_hash").agg(F.count("*").alias("_times"), F.min(F.struct("doc_id", "_key", "_start")).alias("_first")).where("_times > 1").drop("_times")
    counted = materialize(counted)
    places = found.join(counted, "_hash").withColumn("_own", F.struct("doc_id", "_key", "_start").eqNullSafe(F.col("_first")))
    marks = places.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("_start", "_n", "_hash", "_own")).alias("_marks"))
    text = keyed(docs).join(marks, ["doc_id", "_key"])
    with_bytes = F.transform("_marks", lambda m: F.struct(m["_start"].alias("_start"), m["_n"].alias("_n"), m["_hash"].alias("_hash"), m["_own"].alias("_own"), said(m["_start"], m["_n"]).alias("_bytes")))
    each = materialize(text.select("doc_id", "_key", F.explode(with_bytes).alias("_m")).select("doc_id", "_key", "_m.*"))
    discard(counted)
    first = each.where("_own").select("_hash", F.col("_bytes").alias("_first_bytes"))
    again = each.where("NOT _own").join(first, "_hash").where("_bytes = _first_bytes")
    return again.groupBy("doc_id", "_key").agg(F.collect_set(F.struct(F.col("_start").alias("start"), F.col("_n").alias("n"))).alias("_gone"))


def _left(docs: DataFrame) -> DataFrame:
    """set_aside(docs) with text less its repeated chunks, n_lines and n_removed."""
    gone = repeated_lines(docs.where("doc_id IS NOT NULL").select("doc_id", "text"))
    own = set_aside(docs, _key=F.xxhash64(F.coalesce("text", F.lit("")))).join(gone, ["doc_id", "_key"], "left").withColumn("_ls", lines(F.col("text")))
    # what lies before, between and behind the chunks that go; they don't overlap
    ends = F.concat(F.array(F.struct(F.lit(1).alias("start"), F.lit(0).alias("n"))), F.array_sort("_gone"))
    starts = F.concat(F.transform(F.array_sort("_gone"), lambda g: g["start"]), F.array(F.size("_ls") + 1))
    stays = F.flatten(F.zip_with(ends, starts, lambda g, s: F.slice("_ls", g["start"] + g["n"], s - g["start"] - g["n"])))
    removed = F.aggregate("_gone", F.lit(0).cast("long"), lambda n, g: n + g["n"])
    changed = F.col("_gone").isNotNull()
    return own.select(
        "_row", "doc_id", F.when(changed, F.array_join(stays, "\n")).otherwise(F.col("text")).alias("text"),
        F.size("_ls").cast("long").alias("n_lines"), F.when(changed, removed).otherwise(F.lit(0)).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, length: str | None = None) -> DataFrame:
    """docs with text less its repeated chunks. A column `length` is set to the code points of those texts that lose
    lines.

    Rows keep their other columns, whatever these are called. Texts that lose nothing, null ones among them, stay
    as they are; one that loses all is empty. Rows with a null doc_id take no part and stay. Rows that share a
    doc_id and a text are one document: what it keeps, each of them keeps. Texts that share a doc_id only are
    documents of their own.
    """
    kept = _left(docs)
    kind = docs.schema[length].dataType if length else None
    instead = {length: F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("_row").getField(length))} if length else {}
    return kept.select(*taken_back(docs.columns, **instead))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and kept_sha256 of each document's kept text (null: empty)."""
    kept = F.coalesce("text", F.lit(""))
    return _left(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.length(kept).cast("long").alias("n_chars"), F.sha2(kept, 256).alias("kept_sha256"))


ORACLE = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS i FROM split),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM line),
rolled AS (
  SELECT *, i > 2 AND (((lag(h, 2) OVER w * {BASE}) % {MODULUS} + lag(h, 1) OVER w) % {MODULUS}) % {SPREAD} = 0 AS ends
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), apart AS (
  SELECT *, CASE WHEN i = 1 OR ends AND NOT lag(ends) OVER w AND lead(i) OVER w IS NOT NULL THEN 1 ELSE 0 END AS starts
  FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM apart),
chunk AS (SELECT doc_id, c, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes FROM numbered GROUP BY doc_id, c),
verdict AS (SELECT doc_id, c, n > 1 AND row_number() OVER (PARTITION BY bytes ORDER BY doc_id, start) > 1 AS gone FROM chunk WHERE n > 1),
kept AS (SELECT a.doc_id, a.line, a.i, coalesce(v.gone, false) AS gone FROM numbered a LEFT JOIN verdict v ON a.doc_id = v.doc_id AND a.c = v.c),
text AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS t FROM kept GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(t) AS n_chars, sha256(t) AS kept_sha256 FROM text
"""
