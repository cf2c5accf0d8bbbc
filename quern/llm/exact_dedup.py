"""Exact dedup by content sort (native DataFrame operators only).

Normalised text is range-partitioned by sampled splitters
(``repartitionByRange`` samples its input to choose them), sorted externally
inside each range so that equal texts are adjacent, and neighbouring rows are
compared in full by the window's group boundary.  Splitters hold the first
characters of a text, its 64-bit hash and a salt, so the sample that chooses them
is small however long texts are; range partitioning by these columns already
clusters a window over them and the text, so text moves through one shuffle.

A text with very many copies would fill one range.  A first pass counts rows by
64-bit hash (partial aggregation, so a hot text costs one row per map task);
texts above the hot threshold get a salt, which lets the splitters cut through
the group.  The threshold is a share of the rows, so there are at most
``hot_fraction ** -1`` hot texts, and that bounds the broadcasts.  The sort leaves
a hot text in at most ``salts`` runs.  Each run's head keeps its text; heads are
compared in full with each other, and what their group comes to goes back to the
runs.  Hashes choose where a row goes and never whether two texts are equal.

Nulls count as the empty text; repeated doc_ids are separate rows of one group;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import ascii_lower, cut, once, row_key, without_rows

HOT_FRACTION = 1 / 2000
SALTS = 64
HEAD = 32  # characters of the text in a splitter


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, keep: str, hot_fraction: float, salts: int) -> DataFrame:
    """doc_id, raw (hash of the text as it is), sha, keep_id, group_size per row, from the content sort."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    raw_id, raw = row_key(id_col, text_col)
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(raw_id.alias("doc_id"), raw.alias("raw"), norm.alias("norm"))
    rows = rows.withColumn("x", F.xxhash64("norm"))

    counts = rows.groupBy("x").agg(F.count(F.lit(1)).alias("hot_n"))
    total = rows.select(F.count(F.lit(1)).alias("n_rows"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("hot_n") > F.greatest(F.lit(100), F.col("n_rows") * hot_fraction)).drop("n_rows")  # total is one row

    tagged = rows.join(F.broadcast(hot), "x", "left")
    salt = F.when(F.col("hot_n").isNotNull(), F.pmod(F.xxhash64("doc_id", "raw"), F.lit(salts)).cast("int")).otherwise(-1)
    # Splitters are sampled whole and go to the driver, so they are short: the head of the text, then its hash.
    ranged = tagged.withColumn("salt", salt).withColumn("head", F.substring("norm", 1, HEAD)).repartitionByRange("head", "x", "salt")
    run = Window.partitionBy("head", "x", "salt", "norm")
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    runs = ranged.withColumns({"first": F.row_number().over(run.orderBy(order)), "run_id": best("doc_id").over(run), "run_n": F.count(F.lit(1)).over(run)})
    sha = F.sha2(F.encode("norm", "UTF-8"), 256)
    text = F.when((F.col("salt") >= 0) & (F.col("first") == 1), F.col("norm"))  # only the heads of salted runs keep their text
    runs = cut(runs.select("doc_id", "raw", sha.alias("sha"), "salt", "run_id", "run_n", text.alias("text")))

    # At most salts / hot_fraction heads, whatever the size of the table.
    heads = runs.where("text IS NOT NULL").groupBy("text").agg(best("run_id").alias("all_id"), F.sum("run_n").alias("all_n"), F.collect_set(F.struct("sha", "salt", "run_id")).alias("of"))
    back = heads.select("all_id", "all_n", F.explode("of").alias("o")).select("all_id", "all_n", F.col("o.sha").alias("b_sha"), F.col("o.salt").alias("b_salt"), F.col("o.run_id").alias("b_id"))
    same = (F.col("sha") == F.col("b_sha")) & (F.col("salt") == F.col("b_salt")) & F.col("run_id").eqNullSafe(F.col("b_id"))
    out = runs.drop("text").join(F.broadcast(back), same, "left")
    return out.select("doc_id", "raw", "sha", F.when(F.col("all_n").isNull(), F.col("run_id")).otherwise(F.col("all_id")).alias("keep_id"), F.coalesce("all_n", "run_n").alias("group_size"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hot_fraction: float = HOT_FRACTION, salts: int = SALTS
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is the identifier that stays in a group, ``smallest`` or ``largest``;
    a null id stays only where no other has the text.  Rows that repeat the id
    that stays are all marked kept here; ``drop_copies`` leaves one of them.
    """
    out = sorted_runs(docs, id_col, text_col, keep, hot_fraction, salts)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hot_fraction: float = HOT_FRACTION, salts: int = SALTS) -> DataFrame:
    """One row of ``docs`` per text, with the columns of ``docs``.

    Rows go by (id, text), so an id that has several texts keeps those that are
    not copies.  Of rows with the id that stays and equal texts, the one whose
    text has the smaller hash stays; of wholly repeated ones, any one.
    """
    out = cut(sorted_runs(docs, id_col, text_col, keep, hot_fraction, salts))
    stays = out.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("sha").agg(F.min("raw").alias("one"), F.sum(F.lit(1)).alias("n"), F.min("doc_id").alias("k_id"))
    several = stays.where("n > 1").select(F.col("sha").alias("s_sha"), "one")  # ids that repeat with one text, rarely any
    gone = out.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("k_id"), F.col("raw").alias("k_text"))
    if several.isEmpty():
        return without_rows(docs, gone, id_col, text_col)
    twin = out.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).join(several, F.col("sha") == F.col("s_sha"))
    gone = gone.unionByName(twin.where("raw <> one").select(F.col("doc_id").alias("k_id"), F.col("raw").alias("k_text")))
    again = twin.where("raw = one").groupBy(F.col("doc_id").alias("k_id"), F.col("raw").alias("k_text")).count().where("count > 1").drop("count")
    return once(without_rows(docs, gone, id_col, text_col), again, id_col, text_col)
