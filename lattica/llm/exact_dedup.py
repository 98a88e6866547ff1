"""Exact dedup: groups by a 128-bit content hash, whose bytes are compared before a row is dropped.

DataFrame functions only.

1. Every text is normalised (A-Z to a-z) and hashed once; a narrow table of ids and hashes is kept.
2. Hashes that occur twice or more are the candidates.  Their texts, and no others, are grouped by hash *and* text: equal
   keys mean equal bytes, and since copies are combined in the map task, a group of any size sends one row a task.
3. A hash that turns out to have several texts is a collision; its rows are told apart by the text itself.
4. Each row is given its group.  A group of more than a HOT_SHARE-th of all rows is one of HOT_SHARE at most, so
   these groups are broadcast; a join on the hash, of groups below that share, does the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import BROADCAST_KEYS, Kept, col

#: A group of more than one row in HOT_SHARE is joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _attach(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with ``first`` and ``n`` of their group, null for those of none: hot groups by broadcast, others by a join on the keys."""
    hot = groups.where(F.col("n") * HOT_SHARE > total)
    named = [F.col(c).alias(f"hot_{c}") for c in ("first", "n")]
    marked = rows.join(F.broadcast(hot.select(*keys, *named)), keys, "left")
    done = marked.where("hot_n IS NOT NULL").select(*[F.col(c) for c in rows.columns], F.col("hot_first").alias("first"), F.col("hot_n").alias("n"))
    rest = marked.where("hot_n IS NULL").select(*rows.columns)
    return done.unionByName(rest.join(groups.where(F.col("n") * HOT_SHARE <= total), keys, "left").select(*rows.columns, "first", "n"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal if they are after lower-casing A-Z; null counts as empty, and empty texts are copies of each other.  Of equal texts the
    row of the ``keep`` (smallest or largest) id stays.  A null id gives way to any other; if a group has no other, its rows are all kept.
    Rows that repeat an id and its text count each in ``group_size`` and are kept or dropped together (``without_copies`` leaves one).
    Ids may be of any type that has an order; other columns are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    texts = docs.select(col(id_column).alias("id"), normalised(col(text_column)).alias("text")).withColumn("hash", hash_of(F.col("text")))
    rows = Kept(texts.select("id", "hash", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")), "hashed").df
    total = rows.count()
    counts = Kept(rows.groupBy("hash").agg(F.count("*").alias("n"), best("id").alias("first")).where("n > 1"), "copies").df

    several = counts.select("hash")
    few = several.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    # Beyond, a join on the hash would move all texts by it; the grouping alone moves each once, copies combined.
    copied = texts.join(F.broadcast(several), "hash", "left_semi") if few else texts
    by_text = copied.groupBy("hash", "text").agg(F.count("*").alias("n"), best("id").alias("first"))
    collided = Kept(by_text.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash"), "collided").df
    if collided.isEmpty():
        found = _attach(rows, counts, ["hash"], total)
    else:
        apart = texts.join(collided, "hash", "left_semi")
        pure = _attach(rows.join(collided, "hash", "left_anti"), counts, ["hash"], total)
        groups = Kept(apart.groupBy("hash", "text").agg(F.count("*").alias("n"), best("id").alias("first")), "apart").df
        told = _attach(apart.select("id", "hash", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")), groups, ["hash", "text"], total)
        found = pure.unionByName(told.drop("text"))
    alone = F.col("n").isNull()
    keep_id = F.when(alone, F.col("id")).otherwise(F.col("first"))
    size = F.coalesce("n", F.lit(1)).cast("long")
    return found.select(F.col("id").alias(id_column), keep_id.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat an id and its text, any one."""
    told = Kept(exact_duplicates(docs, id_column, text_column, keep), "told").df
    stay = told.where("kept").select(F.struct(col(id_column).alias("i"), F.col("text_sha256").alias("t")).alias("_row")).distinct()
    row = F.struct(col(id_column).alias("i"), F.sha2(F.encode(normalised(col(text_column)), "UTF-8"), 256).alias("t"))
    # Null-safe, since an id may be null.
    whole = docs.select(F.struct(*[col(c).alias(c) for c in docs.columns]).alias("doc"), row.alias("_own"))
    return whole.join(stay, F.col("_own").eqNullSafe(F.col("_row")), "left_semi").dropDuplicates(["_own"]).select("doc.*")
