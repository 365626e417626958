"""Document fingerprints: one-permutation MinHash in DataFrame functions only.

The five-word shingles of a text are hashed once. The top bits of a hash choose one of
``BINS`` bins, and each bin keeps its smallest hash. An empty bin takes the value of
another, chosen by a hash of the bin and the attempt until one is not empty (optimal
densification). ``BITS`` low-order bits of each bin are packed as hex; the likeness of two
fingerprints is the share of equal bins, corrected for bits that are equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.mixing import running_total
from wayfold.llm.shared import keep, shared_folder

WIDTH = 5
BINS = 128
BITS = 8
#: Bits are kept as signed bytes, less this.
HALF = 1 << (BITS - 1)
#: Random attempts of the densification; after them the bins are searched in turn.
ATTEMPTS = 24
_SHIFT = 64 - (BINS - 1).bit_length()
_REST = (1 << _SHIFT) - 1
SPACE = r"[\x20\x09-\x0D]+"


def minima(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the ``BITS`` low-order bits of every bin of the column ``text``
    as an array of bytes, null for a text without words. Letters count in lower case."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE)
    df = df.withColumn("_words", F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))
    own = F.slice("_words", 1, F.greatest(F.lit(0), F.size("_words") - (WIDTH - 1)))
    shingles = F.transform(own, lambda w, i: F.xxhash64(w, *(F.get("_words", i + k) for k in range(1, WIDTH))))
    # Fewer words are one shingle. A last hash for each bin stands for an empty bin.
    shingles = F.when(F.size("_words") >= WIDTH, shingles).otherwise(F.array(F.xxhash64("_words")))
    lasts = F.lit([((b - BINS // 2) << _SHIFT) + _REST for b in range(BINS)])
    df = df.withColumn("_sorted", F.sort_array(F.concat(shingles, lasts)))
    # In order, the hashes of a bin stand together and the first of them is its smallest.
    first = F.filter("_sorted", lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get("_sorted", i - 1), _SHIFT)))
    rest = F.lit(_REST)
    df = df.withColumn("_bins", F.transform(first, lambda h: F.when(h.bitwiseAND(rest) != rest, (h.bitwiseAND(F.lit((1 << BITS) - 1)) - HALF).cast("tinyint"))))
    tries = lambda i: [F.get("_bins", F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(ATTEMPTS)]
    turn = lambda i: F.get(F.filter(F.concat(F.slice("_bins", i + 1, BINS), F.col("_bins")), lambda x: x.isNotNull()), 0)
    filled = F.transform("_bins", lambda x, i: F.coalesce(x, *tries(i), turn(i)))
    return df.withColumn(out, F.when(F.size("_words") > 0, filled)).drop("_words", "_sorted", "_bins")


def packed(bins: Column) -> Column:
    """The fingerprint as lower-case hex; empty for a text without words."""
    digits = BITS // 4
    return F.coalesce(F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x.cast("int") + HALF)), digits, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two shingle sets, 0 to 1. Texts without words are
    like each other and unlike all others."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(BINS)
    chance = 2.0**-BITS
    rated = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(rated)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's whole text and of its edited text.

    Documents stand in descending order of ``doc_id`` (nulls last), the first following the
    last. In the edited text the last third of the code points, rounded down, is replaced
    by as many of the next document. A null text is empty. Rows that repeat an id and text
    count once for the order and are returned each; rows that repeat an id stand in the
    order of a hash of their text. Other columns are ignored; an empty table gives an empty
    result. Texts move once; the order is made of ids and lengths alone.
    """
    folder = shared_folder(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Rows are matched by ``row``, which tells a null id from every other.
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha1(F.encode(text, "utf-8")))
    # The id is read back from ``row``, so both reads below move the same two columns and
    # Spark shuffles the texts once.
    rows = docs.select(text.alias("text"), own.alias("row"))
    of = lambda row: F.expr(f"try_cast(substring_index({row}, ':', 1) AS long)")
    ids = docs.select(own.alias("row"), F.length(text).alias("n_chars")).distinct().withColumn("doc_id", of("row")).withColumn("one", F.lit(1))
    ids = keep(running_total(ids, [F.desc_nulls_last("doc_id"), "row"], "one", "place", folder, "ids"), folder, "places")
    before = F.when(F.col("place") == 1, F.lit(ids.count())).otherwise(F.col("place") - 1)
    follow = ids.select(before.alias("place"), F.col("row").alias("next"))
    order = ids.join(follow, "place").select("row", "next", F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    order = keep(order, folder, "order")
    lend = order.select(F.col("row").alias("owner"), F.col("next").alias("row"), F.col("cut").alias("owed"))
    lent = rows.join(lend, "row").select(F.col("owner").alias("row"), F.substring("text", 1, F.col("owed")).alias("ahead")).dropDuplicates(["row"])
    both = rows.join(order, "row").join(lent, "row").withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("cut")), "ahead"))
    both = both.withColumn("doc_id", of("row"))
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.encode("edited", "utf-8"), 256)).drop("ahead", "cut")
    both = minima(minima(both, "text", "bins").drop("text"), "edited", "edited_bins").drop("edited")
    made = keep(both, folder, "made")
    others = made.select(F.col("row").alias("next"), F.col("bins").alias("next_bins")).dropDuplicates(["next"])
    return made.join(others, "next").select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
