"""Boxes on pages: which lie in a table, for any number of both, by a sweep over each page."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..views import duck, table

QUERIES, ORACLES = {}, {}
#: fixed value: a block lies in a table if more than this share of it does
INSIDE = 0.5
ROWS = 10_000  # blocks of many pages that leave a task together


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, duck(sql)
        return f

    return add


class _Open:
    """Boxes that the sweep has reached and not left, by their left sides; what lies beside [x0, x1) is found without the others."""

    def __init__(self):
        self.boxes: list[tuple] = []  # (x0, number, x1, y1, what)
        self.widest = 0.0

    def add(self, x0, n, x1, y1, what) -> None:
        insort(self.boxes, (x0, n, x1, y1, what))
        self.widest = max(self.widest, x1 - x0)

    def beside(self, x0, x1, y):
        """Boxes that overlap [x0, x1) and reach below y; those that have ended are dropped as they are met."""
        k = bisect_left(self.boxes, (x0 - self.widest,))
        while k < len(self.boxes) and self.boxes[k][0] < x1:
            if self.boxes[k][3] <= y:
                del self.boxes[k]
                continue
            if self.boxes[k][2] > x0:
                yield self.boxes[k]
            k += 1


def swept(boxes: list[tuple]) -> dict[int, float]:
    """For each block's place, the greatest share of it in one table; boxes: (is_table, x0, y0, x1, y1), of one page."""
    tables, blocks = _Open(), _Open()
    best = {k: 0.0 for k, b in enumerate(boxes) if not b[0]}
    if len(best) in (0, len(boxes)):
        return best  # no blocks, or no tables
    for k in sorted(range(len(boxes)), key=lambda k: boxes[k][2]):
        is_table, x0, y0, x1, y1 = boxes[k]
        if not (x1 > x0 and y1 > y0):
            continue  # no area to share, or a side missing
        own, other = (tables, blocks) if is_table else (blocks, tables)
        for a0, n, a1, b1, _ in other.beside(x0, x1, y0):
            # of two open boxes the later one begins at y0
            shared = (min(x1, a1) - max(x0, a0)) * (min(y1, b1) - y0)
            block = n if is_table else k
            _, c0, d0, c1, d1 = boxes[block]
            best[block] = max(best[block], shared / max(1, (c1 - c0) * (d1 - d0)))
        own.add(x0, k, x1, y1, None)
    return best


def _shares(batches):
    """Rows (page, is_table, block, x0, y0, x1, y1), those of a page together, to the share of each block."""
    import pyarrow as pa

    page, blocks_of, held, out = None, [], [], []
    names, types = ["page", "block", "share"], None

    def told():
        out.extend((page, blocks_of[k], share) for k, share in swept(held).items())
        blocks_of.clear(), held.clear()

    def batch_of():
        batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), types)], names=names)
        out.clear()
        return batch

    for batch in batches:
        types = [batch.schema.field("page").type, batch.schema.field("block").type, pa.float64()]
        page_of, is_table, block_of = (batch.column(c).to_pylist() for c in ("page", "is_table", "block"))
        box = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("x0", "y0", "x1", "y1"))
        for p, block, row in zip(page_of, block_of, zip(is_table, *box)):
            if p != page:
                told()
                page = p
                if len(out) >= ROWS:
                    yield batch_of()
            blocks_of.append(block)
            held.append(row)
    told()
    if out:
        yield batch_of()


def in_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """(page, block, share, in_table) of blocks(page, block, x0, y0, x1, y1): the greatest share that lies in one of tables(page, x0, y0, x1, y1).

    A page's boxes are one task's; the sweep meets only those that overlap, so the time goes with these and the boxes. Pages
    leave a task many at a time. A box that lacks a side shares nothing.
    """
    sides = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    kind = blocks.schema["block"].dataType
    rows = blocks.select("page", F.lit(False).alias("is_table"), "block", *sides).unionByName(tables.select("page", F.lit(True).alias("is_table"), F.lit(None).cast(kind).alias("block"), *sides))
    rows = rows.repartition("page").sortWithinPartitions("page")
    schema = f"page {blocks.schema['page'].dataType.simpleString()}, block {kind.simpleString()}, share double"
    return rows.mapInArrow(_shares, schema).withColumn("in_table", F.col("share") > INSIDE)


@query("""
with t as (select * from spans where block % 3 = 1), s as (select page, block, coalesce((select max(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, (a.x1 - a.x0) * (a.y1 - a.y0))) from t b where b.page = a.page), 0) as share from spans a where block % 3 <> 1)
select page, block, round(share, 9) as share, share > 0.5 as in_table from s""")
def boxes_in_tables(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of which more than half lies in one of their page's tables; here every third box is a table."""
    s = table(spark, d, "spans").select("page", "block", "x0", "y0", "x1", "y1")
    return in_tables(s.where("block % 3 <> 1"), s.where("block % 3 = 1")).withColumn("share", F.round("share", 9))
