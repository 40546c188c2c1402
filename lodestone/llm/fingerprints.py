"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

from random import Random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, materialize, sent_if_small, table

#: Bins are the top bits of a shingle's hash; BITS low-order bits of each bin's least hash are kept.
BIN_BITS, BITS = 7, 8
BINS = 1 << BIN_BITS
#: Tries of densification before the ranked choice, which always ends.
TRIES = 8

#: Cells that a range of ids is cut into at a time, how often at most, and rows of a bucket, about.
WAYS, LEVELS, BUCKET_ROWS = 64, 3, 2048
#: Text that a task of the shuffle gets, about.
PARTITION_BYTES = 32 << 20


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS) + BINS // 2


def with_codes(df: DataFrame, text: str, codes: str, words: int = 5) -> DataFrame:
    """df with codes: an array of BINS low-order codes of the text's fingerprint, or an empty one if it has no word.

    Each distinct shingle of so many words (of all words, where there are fewer) is hashed once; its top bits name
    its bin, whose least hash counts. Empty bins are filled by optimal densification: each bin has its own random
    sequence of bins to borrow from, the same for all documents, and takes the first that isn't empty.
    """
    rng = Random(20170806)
    tries = [F.array(*[F.lit(rng.randrange(BINS)) for _ in range(BINS)]) for _ in range(TRIES)]
    h, sh, low, by_bin = (f"_{name}_{codes}" for name in ("h", "sh", "low", "by_bin"))
    df = df.withColumn(h, F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(words)]))
    df = df.withColumn(sh, F.when(F.size(h) > 0, F.sort_array(each)).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(low, F.filter(F.col(sh), lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(sh), i - 1)))))
    df = df.withColumn(by_bin, F.map_from_arrays(F.transform(F.col(low), lambda x: _bin(x).cast("int")), F.col(low)))

    def of_bin(b: Column) -> Column:
        borrowed = [F.try_element_at(F.col(by_bin), F.get(t, b)) for t in tries]
        ranked = F.array_min(F.transform(F.col(low), lambda x: F.struct(F.xxhash64(b, _bin(x)).alias("r"), x.alias("x"))))["x"]
        return F.coalesce(F.try_element_at(F.col(by_bin), b), *borrowed, ranked).bitwiseAND(2**BITS - 1).cast("int")

    dense = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), of_bin)
    return df.withColumn(codes, F.when(F.size(low) > 0, dense).otherwise(F.array().cast("array<int>"))).drop(h, sh, low, by_bin)


def packed(codes: Column) -> Column:
    """The codes as one lower-case hexadecimal string."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two documents' shingles: equal codes, less those that are equal by chance.

    Without bias but near 0, where a negative estimate becomes 0.
    Two documents without words are alike (1), one without words is unlike any other (0).
    """
    chance = 2.0**-BITS
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(BINS)
    estimate = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """id_col, fingerprint for each row of docs, without a shuffle. Null texts are empty and have the fingerprint ''."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_codes(rows, "_text", "_codes", words).select(id_col, packed(F.col("_codes")).alias("fingerprint"))


def with_buckets(docs: DataFrame, key: str, tie: str) -> DataFrame:
    """docs with _bucket, a number that follows the order of rows: by descending key, nulls last, then by tie.

    Keys are cut at approximate quantiles into WAYS cells, and these again, LEVELS times at most, until a cell has about
    BUCKET_ROWS rows; so buckets are alike however keys are spread. A cell that is much larger holds a frequent key, its
    least one: that key's rows are split by tie, a hash, and so are rows without a key. Only keys and ties are read for
    it; tables of bounds have WAYS ** LEVELS numbers at most, which may be sent to all tasks.
    """
    n, nulls = docs.agg(F.count(key), F.count_if(F.col(key).isNull())).first()
    docs = docs.withColumn("_cell", F.when(F.col(key).isNotNull(), F.lit(0).cast("long")))
    for level in range(LEVELS):
        ways = min(WAYS, -(-n // (BUCKET_ROWS * WAYS**level)))
        if ways < 2:
            break
        bounds = docs.where("_cell is not null").groupBy(F.col("_cell").alias("_of")).agg(F.percentile_approx(key, [k / ways for k in range(1, ways)], 10000).alias("_q"))
        docs = docs.join(F.broadcast(materialize(bounds)), F.col("_cell") == F.col("_of"), "left").withColumn("_at", F.size(F.filter("_q", lambda q: q <= F.col(key))))
        docs = docs.withColumn("_cell", F.when(F.col("_cell").isNotNull(), F.col("_cell") * WAYS + F.col("_at"))).drop("_of", "_q", "_at")
    sizes = docs.where("_cell is not null").groupBy(F.col("_cell").alias("_of")).agg(F.count("*").alias("_c"), F.min(key).alias("_hot")).where(F.col("_c") > 4 * BUCKET_ROWS)
    docs = docs.join(F.broadcast(materialize(sizes)), F.col("_cell") == F.col("_of"), "left")
    share = F.col(tie) / 2.0**64 + 0.5
    part = lambda parts: F.least(F.floor(share * parts), parts - 1).cast("long")
    of_key = F.when(F.col(key) == F.col("_hot"), 1 + part(F.ceil(F.col("_c") / BUCKET_ROWS))).otherwise(0)
    last = F.lit(WAYS**LEVELS).cast("long")
    parts = F.lit(max(1, min(WAYS**LEVELS, nulls // BUCKET_ROWS))).cast("long")
    bucket = F.when(F.col("_cell").isNotNull(), (last - 1 - F.col("_cell")) * 2**40 + of_key).otherwise(last * 2**40 + part(parts))
    return docs.withColumn("_bucket", bucket).drop("_cell", "_of", "_c", "_hot")


def with_guests(docs: DataFrame, key: str, tie: str) -> DataFrame:
    """docs in buckets, with _guest: in the order of rows, each bucket ends with a copy of the row that follows it.

    The first row of all follows the last. Which bucket hosts which row is found on one narrow row a bucket; that
    table is sent to all tasks where its counted rows are few, and else joined by a shuffle.
    """
    docs = with_buckets(docs, key, tie)
    top = F.max(F.struct(F.col(key).alias("key"), F.bitwise_not(F.col(tie)).alias("tie"))).alias("_top")
    tops = materialize(docs.groupBy(F.col("_bucket").alias("_own")).agg(top))
    order = Window.orderBy("_own")
    host = F.coalesce(F.lag("_own").over(order), F.max("_own").over(Window.partitionBy()))
    hosts = materialize(tops.select("_own", F.col("_top.key").alias("_key"), F.bitwise_not(F.col("_top.tie")).alias("_tie"), host.alias("_host")).coalesce(1))
    mine = (F.col("_bucket") == F.col("_own")) & F.col(key).eqNullSafe(F.col("_key")) & (F.col(tie) == F.col("_tie"))
    guests = docs.join(sent_if_small(hosts), mine).withColumn("_bucket", F.col("_host")).drop("_own", "_key", "_tie", "_host")
    return docs.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))


def edit_likeness(docs: DataFrame, words: int = 5) -> DataFrame:
    """Fingerprints of documents and of their edits, and how alike they find an edit and the next document.

    The next document is the one with the next smaller doc_id, for the last the first; the edit puts the next
    text's first floor(n_chars / 3) code points, or all, in the place of as many at the text's end. Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, into buckets that follow the order of doc_id; each bucket also gets the row that follows
    it, so no order over all rows is needed. Buckets are dealt to a partition for each PARTITION_BYTES of text. Null
    texts are empty; null ids come last; rows that repeat an id, or have none, follow each other by a hash of their text,
    and only rows equal in both always share a bucket; a single row follows itself; no rows give no rows; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    rows = with_guests(rows.withColumn("_first", F.xxhash64("_text")), "doc_id", "_first").repartition(partitions, "_bucket")
    order = Window.partitionBy("_bucket").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_first")
    rows = rows.withColumn("_next", F.coalesce(F.lead("_text").over(order), F.lit("")))
    n = F.length("_text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut))
    rows = rows.select("_bucket", "_guest", "doc_id", "_first", "_text", n.cast("long").alias("n_chars"), edited.alias("_edited"))
    rows = with_codes(with_codes(rows, "_text", "_codes", words).drop("_text"), "_edited", "_edited_codes", words)
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).drop("_edited").withColumn("_next_codes", F.lead("_codes").over(order))
    return rows.where(~F.col("_guest")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed(F.col("_codes")).alias("fingerprint"),
        packed(F.col("_edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("_codes"), F.col("_edited_codes")).alias("near_edited"),
        likeness(F.col("_codes"), F.col("_next_codes")).alias("near_next"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))
