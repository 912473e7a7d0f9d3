"""Document fingerprints: 128-bit SimHash of weighted word pairs, and a search by permuted block tables.

DataFrame and SQL functions only. Each term's hash votes with the term's weight on 128 signed bits; a text's repeats of a term
vote again, so term frequency is part of the weight. Two fingerprints within ``radius`` bits agree on two of ``radius + 2``
blocks at least, so one table for each two blocks, permuted to the front as its key, holds every such pair.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stash, table, words

BITS = 128
#: Radius of the search: at most this many of the 128 bits differ (an estimated cosine of 0.989 or more).
RADIUS = 6
#: Rows aimed at in a range of ids, and the most ranges that are cut.
RANGE_ROWS, MAX_RANGES = 4096, 20_000
#: A word longer than this (no spaces between words) stands for all its stretches of ``PIECE`` code points.
LONG_WORD, PIECE = 24, 6


def weighted_terms(text: Column) -> Column:
    """The words of a text, from which neighbouring pairs are taken as terms; in place of a long word its pieces, one from each of
    its code points. That holds for each word by itself, so texts that differ in one word differ in that word's terms."""
    plain = words(text)
    pieces = lambda w: F.when(F.char_length(w) > LONG_WORD, F.regexp_extract_all(w, F.lit(f"(?s)(?=(.{{{PIECE}}}))"), 1)).otherwise(F.array(w))
    # A text without a long word, as most are, is its words; it needn't be put together again.
    return F.when(F.coalesce(text, F.lit("")).rlike(f"[^\\x20\\x09-\\x0D]{{{LONG_WORD + 1}}}"), F.flatten(F.transform(plain, pieces))).otherwise(plain)


def term_weight(term: Column) -> Column:
    """1 to 4: longer pairs say more about a text than pairs of function words."""
    return F.least(F.lit(4), 1 + F.floor(F.octet_length(term) / 6)).cast("long")


def _votes(h: Column, w: Column, tag: str) -> list[Column]:
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x0000000100000001)) * w).alias(f"{tag}{j}") for j in range(32)]


def _signs(total: Column, tag: str) -> Column:
    """Bits whose signed sum is positive: over half of the weight voted for them."""
    parts = []
    for j in range(32):
        low, high = F.col(f"{tag}{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"{tag}{j}"), 32)
        top = (1 << (j + 32)) - (1 << 64 if j == 31 else 0)
        parts += [F.when(low * 2 > total, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")), F.when(high * 2 > total, F.lit(top).cast("long")).otherwise(F.lit(0).cast("long"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.bitwiseOR(x)
    return out


def simhash(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``keys``, ``hi`` and ``lo`` (the fingerprint's longs) for each row; ``keys`` must tell the rows apart.

    A text without words (null, empty) has no votes and gets 0; a text of one word has that word as its only term.
    """
    p = F.col("_p")
    pair = F.concat_ws(" ", F.get("_w", p), F.get("_w", p + 1))
    counted = (
        rows.select(*keys, weighted_terms(F.col(text)).alias("_w"))
        .select(*keys, "_w", F.size("_w").alias("_n"), F.posexplode("_w").alias("_p", "_x"))
        .where((p == 0) | (p + 1 < F.col("_n")))
        .select(*keys, pair.alias("_term"))
        .select(*keys, F.xxhash64("_term").alias("_h"), term_weight(F.col("_term")).alias("_wt"))
        .select(*keys, "_h", F.xxhash64("_h").alias("_g"), F.when(F.col("_h") == F.xxhash64(F.lit("")), F.lit(0).cast("long")).otherwise(F.col("_wt")).alias("_wt"))
        .groupBy(*keys)
        .agg(F.sum("_wt").alias("_total"), *_votes(F.col("_h"), F.col("_wt"), "a"), *_votes(F.col("_g"), F.col("_wt"), "b"))
    )
    return counted.select(*keys, _signs(F.col("_total"), "a").alias("hi"), _signs(F.col("_total"), "b").alias("lo"))


def differing(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def likeness(bits: Column) -> Column:
    """The cosine that the share of differing bits estimates, 0 where it is negative."""
    return F.greatest(F.lit(0.0), F.cos(bits * math.pi / BITS))


def hex128(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the id, found over two levels; null is in range 0."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    if not groups:
        return F.lit(0)
    tops = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    within = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    top = F.size(F.filter(tops, lambda b: b <= doc_id))
    inner = F.size(F.filter(F.get(within, top - 1), lambda b: b <= doc_id))
    return F.when(doc_id.isNull() | (top == 0), F.lit(0)).otherwise((top - 1) * width + inner)


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _key, _next_id, _next_key, _next_text``: each row, a hash of its text, and those of the row with the next doc_id;
    the last row has the first. Null ids come first; rows of one id are ordered by the hash.

    Rows are dealt by what they hold, so a table may be read again with other splits. Texts are dealt once, by ranges of doc_id cut at
    its quantiles; an id (or null) that fills a range or more is cut further by the hash. The first row of each range is added to the
    range before it.
    """
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_key"))
    n = docs.count()
    parts = min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS), max(1, n))
    shares = F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)] or [0.5], 10 * parts)
    seen = docs.select(shares.alias("q"), F.count("doc_id").alias("n")).first()
    cuts = Counter(seen["q"] or [])
    # How often an id's hashes are halved: an id that fills k ranges is the quantile k times.
    halved = {x: min(14, k.bit_length()) for x, k in cuts.items() if k > 1}
    of_null = min(14, ((n - seen["n"]) * parts // max(1, n)).bit_length())
    piece = lambda bits: F.call_function("shiftright", F.col("_key"), 64 - bits) + F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1)
    own_piece = F.lit(1 << 15).cast("long")
    if halved:
        bits = F.create_map(*[F.lit(v) for x, k in halved.items() for v in (x, k)])
        own_piece = F.coalesce(piece(F.try_element_at(bits, F.col("doc_id"))), own_piece)
    null_piece = piece(F.lit(of_null)) if of_null else F.lit(0).cast("long")
    part = F.when(F.col("doc_id").isNull(), null_piece).otherwise((_range_of(F.col("doc_id"), sorted(cuts)).cast("long") + 1) * (1 << 16) + own_piece)
    own = own.withColumn("_part", part)
    firsts = own.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "_key")).alias("f"))
    before = Window.orderBy(F.col("_part").desc())
    ring = firsts.select(F.col("_part").alias("_p"), F.col("f.doc_id").alias("_d"), F.col("f._key").alias("_g"), F.coalesce(F.lead("_part").over(before), F.max("_part").over(Window.partitionBy())).alias("_to"))
    # The ring has a row for each range, some MAX_RANGES, so that it may be broadcast and the texts stay where they are.
    ends = own.join(F.broadcast(ring), (F.col("_part") == F.col("_p")) & (F.col("_key") == F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    ends = ends.select("doc_id", "text", "_key", F.col("_to").alias("_part"), F.lit(1).alias("_end"))
    along = Window.partitionBy("_part").orderBy("_end", F.col("doc_id").asc_nulls_first(), "_key")
    out = own.withColumn("_end", F.lit(0)).unionByName(ends)
    return out.withColumns({f"_next_{k}": F.lead(c).over(along) for k, c in (("id", "doc_id"), ("key", "_key"), ("text", "text"))}).where("_end = 0").drop("_end", "_part")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, hi, lo, edited_hi, edited_lo, near_edited, near_next`` for each row of ``docs``.

    Null texts count as empty; the edited text of an empty text is empty; in a table of one row the next document is that row;
    repeated rows stay rows; other columns are ignored; an empty table gives no rows.
    """
    pairs = with_next(docs)
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(floor(char_length(text) / 2)))"), F.substring(F.col("_next_text"), F.lit(1), half))
    kept = ["_row", "doc_id", "_key", "_next_id", "_next_key", "n_chars"]
    texts = pairs.withColumns({"_row": F.monotonically_increasing_id(), "n_chars": F.char_length("text").cast("long")}).select(*kept, "text", edited.alias("_edited"))
    texts = texts.select(*kept, F.unhex(F.sha2("_edited", 256)).alias("_sha"), F.posexplode(F.array("text", "_edited")).alias("_which", "_text"))
    both = simhash(texts, "_text", [*kept, "_sha", "_which"])
    of = lambda c, k: F.max(F.when(F.col("_which") == k, F.col(c)))
    one = both.groupBy("_row").agg(
        *[F.max(c).alias(c) for c in (*kept[1:], "_sha")], of("hi", 0).alias("hi"), of("lo", 0).alias("lo"), of("hi", 1).alias("edited_hi"), of("lo", 1).alias("edited_lo")
    )
    one = stash(one, "prints")
    # Rows of one id and text have one fingerprint. A table of a row for each document isn't broadcast, however small its files.
    after = one.groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_g")).agg(F.any_value("hi").alias("_nhi"), F.any_value("lo").alias("_nlo"))
    c = F.col
    return one.join(after.hint("merge"), c("_next_id").eqNullSafe(c("_d")) & (c("_next_key") == c("_g"))).select(
        "doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), "hi", "lo", "edited_hi", "edited_lo",
        likeness(differing(c("hi"), c("lo"), c("edited_hi"), c("edited_lo"))).alias("near_edited"),
        likeness(differing(c("hi"), c("lo"), c("_nhi"), c("_nlo"))).alias("near_next"),
    )


def block_tables(hi: Column, lo: Column, radius: int) -> Column:
    """For each two of ``radius + 2`` blocks of the 128 bits, permuted to the front: the table's number and the blocks' bits."""
    cuts = [BITS * i // (radius + 2) for i in range(radius + 3)]
    take = lambda x, s, e: F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << (e - s)) - 1 if e - s < 64 else -1))

    def block(a: int, b: int) -> Column:
        if b <= 64:
            return take(hi, a, b)
        return take(lo, a - 64, b - 64) if a >= 64 else take(hi, a, 64).bitwiseOR(F.shiftleft(take(lo, 0, b - 64), 64 - a))

    own = [(block(a, b), b - a) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.struct(F.lit(k).alias("t"), F.shiftleft(x, n).bitwiseOR(y).alias("x")) for k, ((x, _), (y, n)) in enumerate(combinations(own, 2))])


def near_search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``q_hi, q_lo, hi, lo, bits``: all of ``prints(hi, lo)`` within ``radius`` bits of each of ``queries(hi, lo)``.

    Both are reduced to distinct fingerprints first, so copies aren't expanded. A pair that several tables hold is reported by
    the first of them. The join on blocks is a plain equi-join, whose hot blocks AQE may split. It is sorted, never broadcast: Spark takes
    an exploded table for as small as what it is made of, and one of 28 rows a fingerprint would go through the driver.
    """
    q = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct().select("*", block_tables(F.col("q_hi"), F.col("q_lo"), radius).alias("_q"))
    all_ = prints.select("hi", "lo").distinct().select("*", F.explode(block_tables(F.col("hi"), F.col("lo"), radius)).alias("_b")).select("hi", "lo", "_b.*")
    q = q.select("q_hi", "q_lo", F.explode("_q").alias("_b")).select("q_hi", "q_lo", "_b.*")
    bits = differing(F.col("q_hi"), F.col("q_lo"), F.col("hi"), F.col("lo"))
    first = F.array_position(F.zip_with(block_tables(F.col("q_hi"), F.col("q_lo"), radius), block_tables(F.col("hi"), F.col("lo"), radius), lambda a, b: a == b), F.lit(True)) - 1
    met = q.join(all_.hint("merge"), (q["t"] == all_["t"]) & (q["x"] == all_["x"]) & (bits <= radius))
    return met.where(first == q["t"]).select("q_hi", "q_lo", "hi", "lo", bits.alias("bits"))


def query(spark, sf_dir: str) -> DataFrame:
    """``n_near``, for documents whose id is divisible by 20: the other documents within ``RADIUS`` bits; null for the rest."""
    rows = stash(fingerprint_documents(table(spark, sf_dir, "documents")), "rows")
    asked = rows.where("doc_id % 20 = 0").select("hi", "lo").distinct()
    copies = rows.groupBy("hi", "lo").count()
    found = near_search(asked, copies).join(copies.hint("merge"), ["hi", "lo"]).groupBy("q_hi", "q_lo").agg((F.sum("count") - 1).alias("n_near"))
    out = rows.join(found, (F.col("hi") == F.col("q_hi")) & (F.col("lo") == F.col("q_lo")), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hex128(F.col("hi"), F.col("lo")).alias("fingerprint"), hex128(F.col("edited_hi"), F.col("edited_lo")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.when(F.col("doc_id") % 20 == 0, F.col("n_near")).alias("n_near"),
    )
