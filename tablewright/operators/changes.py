"""What makes the destination equal the source: inserts, updates, deletes, and what stands in their way.

Key groups (rows of equal canonical keys) are compared by multiset digests that combine map-side, and rows
join the groups' verdicts afterwards, so a key that holds a large part of a table is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import Options, payload_hash
from ..plans.schema import TableSchema
from ..sources.shared import fixed
from . import chunking, digest
from .diff import canonical_of, payload_key, staged

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _canonical(df: DataFrame, schema: TableSchema, key: list[str], options: Options) -> DataFrame:
    ready, at = staged(df, schema, options)
    parts = [(F.col(c), family) for c, family in at.values()]
    made = ready.withColumns({"__key": payload_key(at, key), "__h": payload_hash(parts, options=options)})
    return made.drop(*[c for c, _ in at.values()])


def _groups(df: DataFrame, side: str) -> DataFrame:
    stats = [c.alias(f"{side}_{n}") for c, n in zip(digest.statistics(F.col("__h")), ("n", "sum", "xor", "sq"))]
    return df.groupBy("__key").agg(*stats)


def group_verdicts(src: DataFrame, dst: DataFrame, unique: bool) -> DataFrame:
    """(__key, verdict) of key groups that differ: insert, delete, update (one row each, key unique on
    both sides) or replace."""
    joined = _groups(src, "s").join(_groups(dst, "d").withColumnRenamed("__key", "__dkey"), F.col("__key") == F.col("__dkey"), "full_outer")
    same = (F.col("s_n") == F.col("d_n")) & (F.col("s_sum") == F.col("d_sum")) & (F.col("s_xor") == F.col("d_xor")) & (F.col("s_sq") == F.col("d_sq"))
    single = F.lit(unique) & (F.col("s_n") == 1) & (F.col("d_n") == 1)
    verdict = F.when(F.col("__dkey").isNull(), INSERT).when(F.col("__key").isNull(), DELETE).when(same, None).when(single, UPDATE).otherwise("replace")
    return joined.select(F.coalesce("__key", "__dkey").alias("__key"), verdict.alias("verdict")).where(F.col("verdict").isNotNull())


def change_set(src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, key: list[str], options: Options = Options()) -> DataFrame:
    """(op, phase, address, row): deletes in phase 1, then inserts and updates. ``address`` is the
    destination's raw key of updated and deleted rows, ``row`` the source's row of written ones. Each side is read
    twice, for its groups' digests and for the rows that differ, which are written; operations come from those."""
    left, right = _canonical(src, a, key, options), _canonical(dst, b, key, options)
    verdicts = fixed(group_verdicts(left, right, a.key_unique and b.key_unique))
    row = F.struct(*[F.col(f"`{n}`") for n in a.names])
    address = F.struct(*[F.col(f"`{n}`") for n in key])
    ours = fixed(left.join(verdicts.where(F.col("verdict") != DELETE), "__key").select("__key", "verdict", row.alias("row")))
    theirs = fixed(right.join(verdicts.where(F.col("verdict") != INSERT), "__key").select("__key", "verdict", address.alias("address")))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    inserts = ours.where(F.col("verdict") != UPDATE).select(F.lit(INSERT).alias("op"), F.lit(2).alias("phase"), none(theirs, "address"), "row")
    deletes = theirs.where(F.col("verdict") != UPDATE).select(F.lit(DELETE).alias("op"), F.lit(1).alias("phase"), "address", none(ours, "row"))
    held = theirs.where(F.col("verdict") == UPDATE).select("__key", "address")
    updates = ours.where(F.col("verdict") == UPDATE).join(held, "__key").select(F.lit(UPDATE).alias("op"), F.lit(2).alias("phase"), "address", "row")
    return inserts.unionByName(deletes).unionByName(updates)


def op_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("op").agg(F.count("*").alias("n"))


def apply_changes(dst: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The destination after ``changes``: rows whose raw key is updated or deleted go, written rows come."""
    gone = changes.where(F.col("address").isNotNull()).select(*[F.col(f"address.`{k}`").alias(f"__{k}") for k in key]).distinct()
    match = F.lit(True)
    for k in key:
        match = match & dst[k].eqNullSafe(F.col(f"__{k}"))
    kept = dst.join(gone, match, "left_anti")
    return kept.unionByName(changes.where(F.col("row").isNotNull()).select("row.*"))


def as_rewrites(changes: DataFrame) -> DataFrame:
    """``changes`` with every update as a delete and an insert, so that unique values can change places."""
    none = lambda c: F.lit(None).cast(changes.schema[c].dataType).alias(c)
    update = changes.where(F.col("op") == UPDATE)
    gone = update.select(F.lit(DELETE).alias("op"), F.lit(1).alias("phase"), "address", none("row"))
    come = update.select(F.lit(INSERT).alias("op"), F.lit(2).alias("phase"), none("address"), "row")
    return changes.where(F.col("op") != UPDATE).unionByName(gone).unionByName(come)


# -- unique constraints ----------------------------------------------------------------------------


def tuple_bytes(df: DataFrame, schema: TableSchema, columns: tuple[str, ...], options: Options = Options()) -> Column:
    """A constraint's tuple; null where any part is, as such rows hold no slot."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(f"`{c}`").isNotNull()
    return F.when(whole, canonical_of(df, schema, options, list(columns)))


def source_duplicates(src: DataFrame, schema: TableSchema, columns: tuple[str, ...], options: Options = Options()) -> DataFrame:
    """(slot, n) of tuples that more than one source row holds: no destination could take them."""
    slots = src.select(tuple_bytes(src, schema, columns, options).alias("slot")).where(F.col("slot").isNotNull())
    return slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")


def conflicts(written: DataFrame, dst: DataFrame, src: DataFrame, a: TableSchema, b: TableSchema, key: list[str], columns: tuple[str, ...], range_pass: bool = True, options: Options = Options()) -> DataFrame:
    """(key, chunk_id, holder_key, holder_chunk, verdict) of written source tuples (rows with chunk_id)
    that another destination row holds. Verdicts are those of writing chunk after chunk in key order:
    rewrite (both in the chunk and changed there), safe, conflict, or duplicate (an error of the source).
    ``dst`` carries chunk_id and addressed, whether its key group is changed; rows outside the source's
    range count as deleted first where there is a pass for them."""
    ends = src.agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi")).first()  # one row
    w = written.select(
        tuple_bytes(written, a, columns, options).alias("slot"),
        canonical_of(written, a, options, key).alias("w_key"),
        F.struct(*key).alias("key"),
        F.col("chunk_id"),
    ).where(F.col("slot").isNotNull())
    outside = F.lit(False)
    if ends["lo"] is not None:
        literal = lambda r: F.struct(*[F.lit(r[k]).alias(k) for k in key])
        outside = (F.struct(*key) < literal(ends["lo"])) | (F.struct(*key) > literal(ends["hi"]))
    h = dst.select(
        tuple_bytes(dst, b, columns, options).alias("h_slot"),
        canonical_of(dst, b, options, key).alias("h_key"),
        F.struct(*key).alias("holder_key"),
        F.col("chunk_id").alias("holder_chunk"),
        F.col("addressed"),
        outside.alias("outside"),
    )
    met = w.join(h, (F.col("slot") == F.col("h_slot")) & (F.col("w_key") != F.col("h_key")))
    at = src.select(canonical_of(src, a, options, key).alias("s_key"), tuple_bytes(src, a, columns, options).alias("s_slot"))
    met = met.join(at, F.col("h_key") == F.col("s_key"), "left")
    written_slots = w.select(F.col("slot").alias("ws")).distinct()
    met = met.join(written_slots, F.col("s_slot") == F.col("ws"), "left")
    same_chunk, before = F.col("holder_chunk") == F.col("chunk_id"), F.col("holder_chunk") < F.col("chunk_id")
    verdict = (
        F.when(same_chunk & F.col("addressed"), "rewrite")
        .when(same_chunk, "conflict")
        .when(F.lit(not range_pass), "conflict")
        .when(F.col("outside"), "safe")
        .when(F.col("s_key").isNotNull() & F.col("ws").isNotNull() & (F.col("s_slot") == F.col("slot")), "duplicate")
        .when(before, "safe")
        .otherwise("conflict")
    )
    return met.select("key", "chunk_id", "holder_key", "holder_chunk", verdict.alias("verdict"))


def rewrite_fingerprint(keys: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(chunk_id, fingerprint): identity of the groups that a rewrite touches, from (chunk_id, key_bytes)."""
    listed = F.array_join(F.array_sort(F.collect_set(F.hex("key_bytes"))), ",")
    return keys.groupBy("chunk_id").agg(F.sha2(F.concat(F.lit("|".join(columns) + ":"), listed).cast("binary"), 256).alias("fingerprint"))


# -- samples and batches ---------------------------------------------------------------------------


def sample(changes: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` changes: the first of every kind, then the others in order. A kind contributes
    its first ``limit``, taken by a top-k a kind."""
    if limit <= 0:
        return changes.limit(0)
    firsts = None
    for op in (DELETE, INSERT, UPDATE):
        top = changes.where(F.col("op") == op).orderBy(*order).limit(limit).coalesce(1)
        numbered = top.withColumn("__place", F.monotonically_increasing_id())
        firsts = numbered if firsts is None else firsts.unionByName(numbered)
    return firsts.orderBy((F.col("__place") > 0), "op", "__place").limit(limit).drop("__place")


def batched(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with batch, numbered in the order of a column of distinct values, ``size`` rows each."""
    return chunking.placed(rows, order, F.lit(1)).withColumn("batch", F.floor(F.col("place") / F.lit(size)).cast("long")).drop("place")
