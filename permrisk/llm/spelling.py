"""Spelling variants: words one edit apart meet by bands of letter-parity masks.

A mask has a bit for the parity of each letter's count. One inserted, deleted
or replaced code point flips at most two bits, so of the mask's three bands one
at least is equal. Words meet by an equal band and by length: their common
length, or for an inserted letter that of the shorter. A band of nine or so
letters has few values, so the words that meet by it alone would grow with the
square of the vocabulary; each band is split by the ends of the words, of which
an edit leaves one as it was (the first or last half of the shorter length).
That loses no pair. A pair that several bands or ends share is taken at the
first, and verified by its edit distance.

Only words are joined, never occurrences, which are added up before the
shuffle. Everything is column expressions: no Python runs in tasks.

Results for odd input: a null or empty text has no runs; a null id counts as an
empty one in the checksum; repeated rows count as often as they occur; texts and
runs of any length are taken whole; other columns are not read. Near words of
equal counts rank in code-point order. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permrisk.llm.common import materialize

LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
DROP_EVERY = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS, BANDS = 63, 3
#: Bit k belongs to band k mod 3; letters in order go to bits in turn, so common ones are spread over the bands.
BAND_BITS = [sum(1 << k for k in range(b, BITS, BANDS)) for b in range(BANDS)]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, after the deletions that checksums call for."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        # shorter runs cannot become words
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(h % DROP_EVERY == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def parity_mask(word: Column) -> Column:
    """Bits of the letters that occur an odd number of times; rare letters may share a bit."""

    def flipped(mask: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        place = F.when(code >= 192, code - 166).otherwise(code - 97) % BITS
        return mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))

    return F.aggregate(F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0)), F.lit(0).cast("bigint"), flipped)


def _half(word: Column, size: Column, end: Column) -> Column:
    """The first or last half of ``size`` letters of a word; an edit between words of which the shorter has ``size`` leaves one of both."""
    half = F.floor(size / 2).cast("int")
    return F.when(end == 0, word.substr(F.lit(1), half)).otherwise(word.substr(F.length(word) - half + 1, half))


def _keyed(words: DataFrame, longer: bool) -> DataFrame:
    """A row for each band and end of a word as the shorter or equal one of a pair, or as the longer one."""
    keys = [F.struct(F.lit(b).alias("band"), F.col("mask").bitwiseAND(F.lit(BAND_BITS[b])).alias("bits"), F.lit(e).alias("end")) for b in range(BANDS) for e in range(2)]
    rows = words.select("word", "n", "mask", (F.length("word") - int(longer)).alias("size"), F.explode(F.array(*keys)).alias("key")).select("word", "n", "mask", "size", "key.*")
    return rows.withColumn("half", _half(F.col("word"), F.col("size"), F.col("end")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words (word, n) one edit apart, once."""
    words = words.withColumn("mask", parity_mask(F.col("word")))
    key = ["size", "band", "bits", "end", "half"]
    one = _keyed(words, False)
    left = one.select(*key, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"))
    right = one.withColumn("longer", F.lit(False)).unionByName(_keyed(words, True).withColumn("longer", F.lit(True)))
    right = right.select(*key, "longer", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"))
    flips = F.col("a_mask").bitwiseXOR(F.col("b_mask"))
    earlier = F.lit(False)  # an earlier band is equal too
    for b in range(BANDS - 1):
        earlier |= (F.col("band") > b) & (flips.bitwiseAND(F.lit(BAND_BITS[b])) == 0)
    first_end = _half(F.col("a"), F.col("size"), F.lit(0)) == _half(F.col("b"), F.col("size"), F.lit(0))
    return (
        left.join(right, key).where(F.col("longer") | (F.col("a") < F.col("b"))).where((F.bit_count(flips) <= 2) & ~earlier & ~((F.col("end") == 1) & first_end))
        .where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms (word, form) ends. Counts grow tenfold from word to form, so chains are short and have no cycle."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = materialize(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its commonest near word if that is ten times as common, and the end of that chain."""
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    common = -F.col("best.less") >= FACTOR * F.col("n")
    rows = words.join(best, "word", "left").select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(common, -F.col("best.less")).alias("form_n"),
    )
    rows = materialize(rows, "variants")
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
