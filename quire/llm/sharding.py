"""Sharding along a Hilbert curve over several metadata dimensions, with DataFrame functions only.

Each dimension is cut into 2**bits cells at its own quantiles (strings in the order of whole values), the cells give a
Hilbert index, rows are sorted by it, and equal runs of that order are the shards. Rows that are near in all
dimensions share a shard, so the minima and maxima of each shard's files prune scans by any of the dimensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import hilbert_column, materialise, partitions

BITS = 5
ROW_BITS = 33  # monotonically_increasing_id() holds the row's place in its partition in its low bits


def _text_bounds(df: DataFrame, dim: str, cells: int) -> list[str]:
    """The least values of the second to the last of `cells` equal runs of the rows in the order of a string column.

    Values are compared whole. Distinct values are counted and range-sorted, and the sums of their counts give the runs,
    so neither a value of a third of all rows nor any number of values meets in one task; `cells` values are collected.
    """
    counts = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("n"))
    order = materialise(counts.repartitionByRange(partitions(df), "v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()), "values")
    order = order.withColumn("part", F.shiftright("at", ROW_BITS))
    sums = order.groupBy("part").agg(F.sum("n").alias("part_n")).selectExpr("part", "sum(part_n) over (order by part) - part_n as before", "sum(part_n) over () as total")
    order = order.join(F.broadcast(sums), "part")  # as many rows as partitions
    order = order.selectExpr("v", "before + sum(n) over (partition by part order by at) - n as before", "total")
    runs = order.selectExpr("v", f"before * {cells} div total as cell").groupBy("cell").agg(F.min("v").alias("v"))
    return sorted((r["v"] for r in runs.where("cell > 0").collect()), key=lambda v: v.encode())


def hilbert_key(df: DataFrame, dims: list[str], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """df with the Hilbert index of its dims, as a long column `name`. Nulls lie in a dimension's first cell.

    The bounds are quantiles of all rows, 2**bits - 1 for each dimension: of numbers by one aggregate, of strings by the
    order of their whole values.
    """
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    numbers = [d for d in dims if d not in texts]
    found = df.agg(*[F.percentile_approx(F.col(d).cast("double"), cuts, 10_000).alias(f"q{i}") for i, d in enumerate(numbers)]).first() if numbers else ()
    bounds = {d: [F.lit(float(v)) for v in found[i] or ()] for i, d in enumerate(numbers)} | {d: [F.lit(v) for v in _text_bounds(df, d, 1 << bits)] for d in texts}
    cells = []
    for d in dims:
        value = F.col(d) if d in texts else F.col(d).cast("double")
        reached = (lambda x: lambda bound: bound <= x)(value) if d in texts else (lambda x: lambda bound: bound < x)(value)
        cells.append(F.coalesce(F.when(value.isNotNull(), F.size(F.filter(F.array(*bounds[d]), reached))), F.lit(0)) if bounds[d] else F.lit(0))
    return df.withColumn(name, hilbert_column(cells, bits))


def ranked(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, in the order of keys, and the number of rows as `<name>_of`; df is written once.

    Range partitions are sorted and written; the counts of the partitions, one row for each, give their offsets.
    """
    order = df.repartitionByRange(partitions(df), *keys).sortWithinPartitions(*keys)
    held = materialise(order.withColumn("__id", F.monotonically_increasing_id()), "ranked")
    held = held.withColumn("__part", F.shiftright("__id", ROW_BITS)).withColumn("__id", F.col("__id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
    counts = held.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = counts.selectExpr("__part", "sum(__n) over (order by __part) - __n as __before", f"sum(__n) over () as {name}_of")
    out = held.join(F.broadcast(offsets), "__part")  # as many rows as partitions
    return out.withColumn(name, F.col("__before") + F.col("__id")).drop("__part", "__id", "__before")


def cut_runs(df: DataFrame, shards: int) -> DataFrame:
    """(shard, slot) from (rank, rank_of): runs of the order, whose lengths differ by one at most."""
    base, extra = F.expr(f"rank_of div {shards}"), F.expr(f"rank_of % {shards}")
    large = extra * (base + 1)
    df = df.withColumn("__large", large).withColumn("__base", base).withColumn("__extra", extra)
    first = F.col("rank") < F.col("__large")
    df = df.withColumn("shard", F.when(first, F.expr("rank div (__base + 1)")).otherwise(F.expr("__extra + (rank - __large) div greatest(__base, 1)")).cast("int"))
    df = df.withColumn("slot", F.when(first, F.expr("rank % (__base + 1)")).otherwise(F.expr("(rank - __large) % greatest(__base, 1)")))
    return df.drop("__large", "__base", "__extra")


def shard_rows(df: DataFrame, shards: int = 16, dims: tuple[str, ...] = ("lang", "source", "size"), id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Every row's shard by law `rows`: (id, size, text_crc32, hilbert, shard, slot).

    size is the text's UTF-8 bytes plus 1, and may be one of dims; a null text counts as empty. Equal texts with equal
    metadata lie side by side. Null ids and dimensions are allowed, repeated rows are rows of their own, an empty table
    gives no rows, columns that aren't named are ignored.
    """
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    own = [F.col(d) for d in dims if d not in ("size", id_col)]
    slim = df.select(F.col(id_col).alias("doc_id"), *own, (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    slim = materialise(slim, "shards")  # texts are read and summed up once
    keyed = hilbert_key(slim, list(dims), bits).select("doc_id", "size", "text_crc32", "hilbert")
    return cut_runs(ranked(keyed, ["hilbert", "text_crc32", "doc_id"]), shards).drop("rank", "rank_of")


def write_shards(df: DataFrame, path: str, shards: int = 16, dims: tuple[str, ...] = ("lang", "source", "size"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write df's rows as Parquet under path/shard=K in the curve's order, and return each shard's counts and bounds of dims.

    Rows travel with their keys, whole and once, so ids may be null or repeated; repeated rows are written as often as they
    come. Null texts stay null, long ones are whole. A column named shard is refused, since the folders bear that name; all
    others are written as they are. An empty table writes no rows and returns none.
    """
    if any(c.lower() == "shard" for c in df.columns):
        raise ValueError("df has a column named shard")
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    size = (F.octet_length(raw) + 1).cast("long")
    own = [(size if d == "size" else F.col(d)).alias(f"__{i}") for i, d in enumerate(dims)]
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), *own, size.alias("__size"), F.crc32(raw).alias("__crc"), F.col(id_col).alias("__own"))
    keyed = hilbert_key(rows, [f"__{i}" for i in range(len(dims))], name="__hilbert")
    dealt = cut_runs(ranked(keyed, ["__hilbert", "__crc", "__own"]), shards)
    out = dealt.select("__row", "shard", "slot").sortWithinPartitions("shard", "slot").select("__row.*", "shard")
    out.write.partitionBy("shard").parquet(path)
    bounds = [f(f"__{i}").alias(f"{f.__name__}_{d}") for i, d in enumerate(dims) for f in (F.min, F.max)]
    return dealt.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("__size").alias("n_bytes"), *bounds)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def _oracle(shards: int = 16, bits: int = BITS) -> str:
    """The same in SQL, with exact quantiles (as Spark's are below 10,000 rows), the curve unrolled step by step, and CRC by a table."""
    cells, table = 1 << bits, []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    crc = f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: cast('0x' || x as bigint))), lambda c, b: xor(c >> 8, tab[cast(xor(c & 255, b) as int) + 1])), 4294967295)"

    def text_cell(dim: str) -> str:
        below = f"(select v, sum(n) over (order by v) - n as before from (select {dim} as v, count(*) as n from d where {dim} is not null group by {dim}))"
        starts = f"(select min(v) as v from (select v, before * {cells} // (select count(*) from d where {dim} is not null) as c from {below}) where c > 0 group by c)"
        return f"(select count(*) from {starts} where v <= d.{dim})"

    number_cell = f"len(list_filter((select list_transform(range(1, {cells}), lambda i: s[greatest(cast(ceil(i / {cells}.0 * len(s)) as int), 1)]) from (select list(size order by size) as s from d)), lambda x: x < size))"
    out = f"select *, {text_cell('lang')} as x0, {text_cell('source')} as x1, {number_cell} as x2 from d"
    for q in range(bits - 1, 0, -1):
        for k in range(3):
            p = (1 << q) - 1
            swap = f"(xor(x0, x{k}) & {p})"
            first = f"case when x{k} & {1 << q} <> 0 then xor(x0, {p}) else xor(x0, {swap}) end as x0"
            new = [first] + [f"case when x{k} & {1 << q} <> 0 then x{j} else xor(x{j}, {swap}) end as x{j}" if j == k else f"x{j}" for j in (1, 2)]
            out = f"select doc_id, size, text_crc32, {', '.join(new)} from ({out})"
    out = f"select doc_id, size, text_crc32, x0, xor(x0, x1) as x1, xor(xor(x0, x1), x2) as x2 from ({out})"
    flip = "cast(0 as bigint)"
    for q in range(bits - 1, 0, -1):
        flip = f"xor({flip}, case when x2 & {1 << q} <> 0 then {(1 << q) - 1} else 0 end)"
    out = f"select doc_id, size, text_crc32, xor(x0, {flip}) as x0, xor(x1, {flip}) as x1, xor(x2, {flip}) as x2 from ({out})"
    places = [(q, k) for q in range(bits - 1, -1, -1) for k in range(3)]
    key = " + ".join(f"((x{k} >> {q}) & 1) * {1 << (len(places) - 1 - n)}" for n, (q, k) in enumerate(places))
    run = f"select *, n // {shards} as base, n % {shards} as extra, row_number() over (order by hilbert, text_crc32, doc_id) - 1 as r from (select doc_id, size, text_crc32, cast({key} as bigint) as hilbert, count(*) over () as n from ({out}))"
    return f"""
with b as (select doc_id, lang, source, coalesce(text, '') as t, {table} as tab from documents),
d as materialized (select doc_id, lang, source, cast(strlen(t) + 1 as bigint) as size, cast({crc} as bigint) as text_crc32 from b)
select doc_id, size, text_crc32, 'rows' as law, cast(case when r < extra * (base + 1) then r // (base + 1) else extra + (r - extra * (base + 1)) // greatest(base, 1) end as int) as shard,
  cast(case when r < extra * (base + 1) then r % (base + 1) else (r - extra * (base + 1)) % greatest(base, 1) end as bigint) as slot, cast(null as double) as grown_shard, hilbert from ({run})"""


QUERIES = {"op1_hilbert_shards": op1_hilbert_shards}
ORACLES = {"op1_hilbert_shards": _oracle()}
