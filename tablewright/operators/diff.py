"""Differences between two tables: counts, chunk digests, keyed rows, multisets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.canonical import Options
from ..plans import schema as schemas
from ..plans.schema import TableSchema
from ..sources.shared import fixed
from . import chunking, digest

CHANGED, MISSING_DST, MISSING_SRC, COUNT_DIFF = "CHANGED", "MISSING_IN_DST", "MISSING_IN_SRC", "COUNT_DIFF"


@dataclass(frozen=True)
class Spec:
    """How two tables are compared."""

    key: tuple[str, ...] = ()
    where: str = ""
    ignore: tuple[str, ...] = ()
    chunk_size: int = 10_000
    drill: bool = False
    drill_limit: int = 10
    strict: bool = False
    secure: bool = False
    hash: str = "xxhash64"
    options: Options = Options()
    chunks_always: bool = False  # find the differing chunks even where the counts already differ


@dataclass
class TableResult:
    name: str
    status: str = "OK"  # OK, DIFFERENT or ERROR
    error: str = ""
    src_rows: int = 0
    dst_rows: int = 0
    chunks: int = 0
    src_fp: str = ""
    dst_fp: str = ""
    keyed: bool = False
    diff_chunks: DataFrame | None = None  # chunk_id, lo, hi, src_n, dst_n, src_digest, dst_digest
    some: tuple[DataFrame, DataFrame] | None = None  # both sides' rows of differing chunks, with chunk_id
    rows: DataFrame | None = None  # kind, key, src, dst
    truncated: bool = False  # there are more differing rows than are shown
    warnings: list[str] = field(default_factory=list)


def filtered(df: DataFrame, where: str) -> DataFrame:
    return df.where(F.expr(f"({where})")) if where else df


def canonical_of(df: DataFrame, schema: TableSchema, options: Options, names: list[str] | None = None) -> Column:
    """The canonical bytes of a row, or of some of its columns."""
    chosen = [(F.col(f"`{n}`"), info, kind) for n, info, kind in schemas.kinds(df, schema) if names is None or n in names]
    if names is not None:
        order = {n: i for i, n in enumerate(names)}
        listed = [x for x in schemas.kinds(df, schema) if x[0] in order]
        chosen = [(F.col(f"`{n}`"), info, kind) for n, info, kind in sorted(listed, key=lambda x: order[x[0]])]
    return canonical.canonical_row(chosen, options)


def staged(df: DataFrame, schema: TableSchema, options: Options = Options()) -> tuple[DataFrame, dict[str, tuple[str, str]]]:
    """``df`` with the canonical payload of every column of ``schema`` as a column of its own, so that each
    is computed once, and where: name -> (column, family)."""
    listed = schemas.kinds(df, schema)
    at = {n: (f"__p{i}", info.family) for i, (n, info, _) in enumerate(listed)}
    return df.withColumns({at[n][0]: canonical.payload(F.col(f"`{n}`"), info, kind, options) for n, info, kind in listed}), at


def payload_key(at: dict[str, tuple[str, str]], names: list[str]) -> Column:
    """Canonical payloads of some columns as one comparable value."""
    return F.struct(*[F.col(at[n][0]).alias(f"k{i}") for i, n in enumerate(names)])


def hashed(df: DataFrame, schema: TableSchema, options: Options = Options(), kind: str = "xxhash64") -> DataFrame:
    """``df`` with h, the hash of each canonical row."""
    ready, at = staged(df, schema, options)
    parts = [(F.col(c), family) for c, family in at.values()]
    return ready.withColumn("h", canonical.payload_hash(parts, kind, options)).drop(*[c for c, _ in at.values()])


def counts(src: DataFrame, dst: DataFrame) -> DataFrame:
    """(side, n) of both sides, in one pass over each."""
    return src.agg(F.count("*").alias("n")).select(F.lit("src").alias("side"), "n").unionByName(dst.agg(F.count("*").alias("n")).select(F.lit("dst").alias("side"), "n"))


def _side(df: DataFrame, schema: TableSchema, key: list[str], options: Options, side: str) -> DataFrame:
    ready, at = staged(df, schema, options)
    listed = {n: (info, kind) for n, info, kind in schemas.kinds(df, schema)}
    rest = [n for n in listed if n not in key]
    raw = F.struct(*[F.col(f"`{n}`") for n in listed])
    return ready.select(payload_key(at, key).alias(f"{side}_key"), payload_key(at, rest or key).alias(f"{side}_row"), raw.alias(f"{side}_raw"))


def shown(raw: Column, schema: TableSchema, types: dict, names: list[str]) -> Column:
    return F.concat_ws(" | ", *[canonical.display(raw[n], schema.column(n).info, types[n]) for n in names])


def row_diff(src: DataFrame, dst: DataFrame, src_schema: TableSchema, dst_schema: TableSchema, key: list[str], options: Options = Options()) -> DataFrame:
    """(kind, key, src, dst) of rows that differ, for a key that is unique on both sides. Keys are matched
    by their canonical payloads, whole, so nulls match nulls and no key is too long; only rows that differ
    are rendered."""
    a, b = _side(src, src_schema, key, options, "src"), _side(dst, dst_schema, key, options, "dst")
    joined = a.join(b, F.col("src_key") == F.col("dst_key"), "full_outer")
    kind = F.when(F.col("dst_key").isNull(), MISSING_DST).when(F.col("src_key").isNull(), MISSING_SRC).when(F.col("src_row") != F.col("dst_row"), CHANGED)
    found = joined.withColumn("kind", kind).where(F.col("kind").isNotNull())
    types = [{n: k for n, _, k in schemas.kinds(df, s)} for df, s in ((src, src_schema), (dst, dst_schema))]
    left, right = F.col("src_raw"), F.col("dst_raw")
    keys = F.when(left.isNull(), shown(right, dst_schema, types[1], key)).otherwise(shown(left, src_schema, types[0], key))
    rows = [F.when(raw.isNotNull(), shown(raw, s, t, s.names)) for raw, s, t in ((left, src_schema, types[0]), (right, dst_schema, types[1]))]
    return found.select("kind", keys.alias("key"), rows[0].alias("src"), rows[1].alias("dst"))


def multiset_diff(src: DataFrame, dst: DataFrame, src_schema: TableSchema, dst_schema: TableSchema, options: Options = Options()) -> DataFrame:
    """(kind, row, src_n, dst_n) of canonical rows whose multiplicity differs. Rows are counted by two 64-bit
    hashes of their payloads, map-side before they are exchanged, so what is exchanged is 32 bytes a distinct
    row; only rows whose counts differ are met again, rendered and counted by themselves."""

    def marked(df: DataFrame, schema: TableSchema, flag: int) -> DataFrame:
        ready, at = staged(df, schema, options)
        payloads = [F.col(c) for c, _ in at.values()]
        marks = [F.xxhash64(F.lit(k), *canonical.null_marks(payloads), *payloads).alias(f"h{k}") for k in (1, 2)]
        return ready.select(*payloads, *marks, F.lit(1 - flag).cast("long").alias("s"), F.lit(flag).cast("long").alias("d"))

    both = marked(src, src_schema, 0).unionByName(marked(dst, dst_schema, 1))
    names = [c for c in both.columns if c not in ("h1", "h2", "s", "d")]
    counted = lambda df, *keys: df.groupBy(*keys).agg(F.sum("s").alias("src_n"), F.sum("d").alias("dst_n")).where("src_n != dst_n")
    differ = fixed(counted(both, "h1", "h2").select("h1", "h2"))
    folded = counted(both.join(differ, ["h1", "h2"], "left_semi"), *names)
    kind = F.when(F.col("dst_n") == 0, MISSING_DST).when(F.col("src_n") == 0, MISSING_SRC).otherwise(COUNT_DIFF)
    binary = {"BYTES"}
    row = F.concat_ws(" | ", *[F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(n))) if c.family in binary else F.col(n).cast("string"), F.lit("NULL")) for n, c in zip(names, src_schema.columns)])
    return folded.select(kind.alias("kind"), row.alias("row"), "src_n", "dst_n")


def prepare(src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, spec: Spec) -> tuple[DataFrame, DataFrame, TableSchema, TableSchema, bool, list[str]]:
    """Both sides filtered and projected, their schemas, whether rows can be addressed by key ranges, and
    warnings; an error where the pair can't be compared."""
    warnings: list[str] = []
    if spec.key:
        a, more = schemas.explicit_key(a, list(spec.key))
        b, _ = schemas.explicit_key(b, list(spec.key))
        warnings += more
    a, b = schemas.ignore_columns(a, b, list(spec.ignore))
    warnings += schemas.compatible(a, b, spec.strict, spec.options.tz_swap) + schemas.nullable_key_warning(a)
    keyed = bool(a.key) and bool(b.key)
    if bool(a.key) != bool(b.key):
        warnings.append("only one side has a usable key: whole tables are compared as multisets")
    elif keyed and not schemas.keys_agree(a, b):
        warnings.append(f"keys differ (src {', '.join(a.key)}; dst {', '.join(b.key)}): whole tables are compared as multisets")
        keyed = False
    elif keyed:
        fine, why = schemas.range_addressable(a, b)
        if not fine:
            warnings.append(f"{why}: whole tables are compared as multisets")
            keyed = False
    if keyed and not set(a.key) <= set(a.names):
        keyed = False
    where = lambda df, s: filtered(df, spec.where).select(*[f"`{n}`" for n in s.names])
    return where(src, a), where(dst, b), a, b, keyed, warnings


def chunk_plan(src: DataFrame, a: TableSchema, spec: Spec) -> chunking.IntegerPlan | chunking.RankedPlan | None:
    """Chunks of the source by its key; None for an empty source."""
    key = list(a.key)
    if a.column(key[0]).family in ("INT", "UINT", "YEAR"):
        return chunking.plan_integer(src, key[0], spec.chunk_size)
    bounds = chunking.plan_ranked(src, key, spec.chunk_size)
    n = bounds.count()
    return chunking.RankedPlan(bounds, key, a, n) if n else None


def with_chunk(df: DataFrame, plan: chunking.IntegerPlan | chunking.RankedPlan | None) -> DataFrame:
    """``df`` with chunk_id; without a plan there is one chunk."""
    if isinstance(plan, chunking.RankedPlan):
        return chunking.ranked_chunk_id(df, plan.key, plan.table)
    return df.withColumn("chunk_id", plan.chunk_id() if plan else F.lit(0).cast("long"))


def chunked(src: DataFrame, dst: DataFrame, a: TableSchema, spec: Spec) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with chunk_id, planned on the source, and the number of chunks."""
    plan = chunk_plan(src, a, spec)
    return with_chunk(src, plan), with_chunk(dst, plan), plan.chunks if plan else 0


#: Stretches of differing chunks that are said as key ranges; more are said as the one range that holds them.
MOST_RANGES = 200


def rows_of_chunks(df: DataFrame, plan: chunking.IntegerPlan | chunking.RankedPlan | None, diff_chunks: DataFrame) -> DataFrame:
    """The rows of ``df`` in differing chunks, with chunk_id. Chunks are said as key ranges first, which a scan can
    skip by, and then exactly, by a join."""
    found = diff_chunks.select("chunk_id").orderBy("chunk_id").limit(MOST_RANGES + 1).collect()  # bounded
    if plan is not None:
        stretches = chunking.runs([r["chunk_id"] for r in found])
        if len(found) > MOST_RANGES:
            ends = diff_chunks.agg(F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi")).first()
            stretches = [(ends["lo"], ends["hi"])]
        df = df.where(plan.within(stretches))
    return with_chunk(df, plan).join(diff_chunks.select("chunk_id"), "chunk_id", "left_semi")


def chunk_digests(src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, plan: chunking.IntegerPlan | chunking.RankedPlan | None, spec: Spec = Spec()) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, n, sum_h, xor_h, sumsq_h) of both sides, in one written job."""
    hashes = (hashed(with_chunk(df, plan), s, spec.options, spec.hash) for df, s in ((src, a), (dst, b)))
    left, right = (x.select(F.lit(side).alias("side"), "chunk_id", "h") for x, side in zip(hashes, ("src", "dst")))
    digests = fixed(left.unionByName(right).groupBy("side", "chunk_id").agg(*digest.statistics(F.col("h"))))
    return tuple(digests.where(F.col("side") == side).drop("side") for side in ("src", "dst"))


def compare(name: str, src: DataFrame, dst: DataFrame, a: TableSchema, b: TableSchema, spec: Spec = Spec()) -> TableResult:
    """Are the two tables the same? Counts first; equal counts are compared by chunk digests; on demand
    the rows of differing chunks are shown."""
    result = TableResult(name)
    try:
        src, dst, a, b, result.keyed, result.warnings = prepare(src, dst, a, b, spec)
        n = {r["side"]: r["n"] for r in counts(src, dst).collect()}
        result.src_rows, result.dst_rows = n["src"], n["dst"]
        if result.src_rows != result.dst_rows:
            result.status = "DIFFERENT"
            if not (spec.drill or spec.chunks_always):
                return result
        plan = chunk_plan(src, a, spec) if result.keyed else None
        result.chunks = plan.chunks if plan else int(not result.keyed and result.src_rows > 0)
        ours, theirs = chunk_digests(src, dst, a, b, plan, spec)
        result.src_fp, result.dst_fp = (digest.table_fingerprint(x, spec.secure).first()["fingerprint"] for x in (ours, theirs))
        differ = fixed(digest.differing(ours, theirs))
        result.diff_chunks = plan.shown(differ) if plan else differ.withColumns({"lo": F.lit("-"), "hi": F.lit("-")})
        if not differ.isEmpty():
            result.status = "DIFFERENT"
            result.some = tuple(rows_of_chunks(x, plan, differ) for x in (src, dst))
            if spec.drill:
                drill(a, b, result, spec)
    except schemas.PlanError as error:
        result.status, result.error = "ERROR", str(error)
    return result


def drill(a: TableSchema, b: TableSchema, result: TableResult, spec: Spec) -> None:
    """The first differing rows in order of their keys' text, from differing chunks only, and whether there are
    more."""
    left, right = (x.drop("chunk_id") for x in result.some)
    if result.keyed and a.key_unique and b.key_unique:
        found = row_diff(left, right, a, b, list(a.key), spec.options)
    else:
        found = multiset_diff(left, right, a, b, spec.options).select(
            "kind", F.lit("").alias("key"), F.concat("row", F.lit(" x"), "src_n").alias("src"), F.concat("row", F.lit(" x"), "dst_n").alias("dst")
        )
    first = fixed(found.orderBy("key", "kind", "src", "dst").limit(spec.drill_limit + 1))
    result.truncated = first.count() > spec.drill_limit
    result.rows = first.orderBy("key", "kind", "src", "dst").limit(spec.drill_limit)
    if result.truncated:
        result.warnings.append(f"more rows differ than the {spec.drill_limit} shown")
