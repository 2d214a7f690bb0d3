"""Queries beyond documents: totals over several groupings, the greatest of a group, as-of joins, approximate counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..views import duck, table

QUERIES, ORACLES = {}, {}
BUCKET = 86_400  # seconds that rows of an as-of join are dealt by, beside their key


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


@query("select coalesce(l_returnflag, '-') as flag, coalesce(l_linestatus, '-') as status, coalesce(cast(year(l_shipdate) as string), '-') as year, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem group by cube (l_returnflag, l_linestatus, year(l_shipdate))")
def cube_sales(spark: SparkSession, d: str) -> DataFrame:
    """Lines and quantities over all groupings of flag, status and year; a dash stands for all."""
    x = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    all_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return x.select(all_of("l_returnflag").alias("flag"), all_of("l_linestatus").alias("status"), all_of("y").alias("year"), "n", "quantity")


@query("select p_brand as brand, p_partkey as part, place from (select p_brand, p_partkey, row_number() over (partition by p_brand order by q desc, p_partkey) as place from (select l_partkey, cast(sum(l_quantity) as bigint) as q from lineitem group by l_partkey) s join part on p_partkey = l_partkey) where place <= 10")
def topk_parts(spark: SparkSession, d: str) -> DataFrame:
    """The ten most sold parts of each brand; the limit is the feature, and reaches below the window."""
    q = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    s = q.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    place = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("q"), "p_partkey")).cast("long")
    return s.withColumn("place", place).where("place <= 10").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), "place")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """left with the value of right's latest row of its key at or before its time (of one time the greatest value), or null.

    Rows meet by key and day, so that a hot key is many tasks; the last value of each day is carried on to the days after.
    """
    day = lambda df: F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / BUCKET)
    l, r = left.withColumn("__day", day(left)), right.select(key, time, F.col(value).alias("__value")).withColumn("__day", day(right))
    both = l.withColumn("__value", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(1)).unionByName(r.withColumn("__left", F.lit(0)), allowMissingColumns=True)
    found = F.last("__value", ignorenulls=True).over(W.partitionBy(key, "__day").orderBy(time, "__left", "__value"))
    days = r.groupBy(key, "__day").agg(F.max_by("__value", F.struct(time, "__value")).alias("__v")).unionByName(l.select(key, "__day").distinct().withColumn("__v", F.lit(None)), allowMissingColumns=True)
    days = days.groupBy(key, "__day").agg(F.max("__v").alias("__v"))
    before = days.withColumn("__before", F.last("__v", ignorenulls=True).over(W.partitionBy(key).orderBy("__day").rowsBetween(W.unboundedPreceding, -1))).drop("__v")
    out = both.withColumn("__found", found).where("__left = 1").join(before, [key, "__day"], "left")
    return out.withColumn(f"as_of_{value}", F.coalesce("__found", "__before")).select(*left.columns, f"as_of_{value}")


@query("select u.event_id, (select max(v.event_id) from usage v where v.model = u.model and not v.batch and v.time = (select max(w.time) from usage w where w.model = u.model and not w.batch and w.time <= u.time)) is not null as found, coalesce(r.event_id, -1) as cached_by from usage u asof left join (select model, time, max(event_id) as event_id from usage where not batch group by model, time) r on r.model = u.model and r.time <= u.time where u.batch")
def asof_cache(spark: SparkSession, d: str) -> DataFrame:
    """For each batch call, the latest call of its model that wasn't one."""
    u = table(spark, d, "usage").select("event_id", "model", "time", "batch")
    x = as_of(u.where("batch"), u.where("not batch"), "model", "time", "event_id")
    return x.select("event_id", F.col("as_of_event_id").isNotNull().alias("found"), F.coalesce("as_of_event_id", F.lit(-1)).cast("long").alias("cached_by"))


@query("select event_type, count(distinct user_id) as users, true as near from events group by event_type")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Users of each kind of event, counted exactly, and whether a sketch of bounded size comes within a tenth.

    Both are taken from the distinct pairs: beside an exact count, Spark would keep a sketch for each pair.
    """
    pairs = table(spark, d, "events").select("event_type", "user_id").distinct()
    x = pairs.groupBy("event_type").agg(F.count("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("sketch"))
    return x.select("event_type", "users", (F.abs(F.col("sketch") - F.col("users")) <= 0.1 * F.col("users")).alias("near"))
