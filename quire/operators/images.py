"""Images of books and the pages that they stand on: scans, decoration, repeated images, and pages put together from spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as X
from ..sources.pictures import with_headers
from ..views import duck, table
from .books import with_tables
from .documents import MOST_USES, SCANNED_CHARS

QUERIES, ORACLES = {}, {}
#: fixed values: names and alternative texts of decoration, the least size of an image in bytes and pixels
NAME_PATTERNS = ("cover", "title_page", "_logo", "logo_", "next-reads", "backad", "globalback", "ornament", "divider", "000_bar", "000_section")
ALT_KEYWORDS = ("ornament", "logo", "next reads", "next-reads", "decorative")
LEAST_BYTES, LEAST_PX = 3000, 100
#: fixed values: the part of a page that a scan covers; the least side (points) and part of a page of an image; pages that an image may stand on
SCAN_SHARE, LEAST_PT, LEAST_SHARE, MOST_PAGES = 0.85, 72, 0.02, 3
#: fixed values: why an image is dropped
BY_NAME, TOO_SMALL, SMALL_AREA = "reglas: nombre/alt de adorno", "reglas: muy pequeña", "reglas: área muy pequeña"
SMALL_FILE = "reglas: muy pequeña ({w}x{h}px, {bytes} bytes)"
REPEATED = "reglas: repetida {n} veces (viñeta/separador)"
ON_PAGES = "reglas: repetida en {n} páginas (logo/fondo)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def any_in(text: Column, words) -> Column:
    """Whether a text holds one of the words, whatever its case."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w))
    return out


def rule_reason(name: Column, alt: Column, size: Column, w: Column, h: Column) -> Column:
    """Why rules take an image for decoration, or an empty string; sides of 0 are unknown."""
    small = (size < LEAST_BYTES) | ((w > 0) & (h > 0) & ((w < LEAST_PX) | (h < LEAST_PX)))
    shown = X.fill(SMALL_FILE, {"w": w.cast("string"), "h": h.cast("string"), "bytes": F.format_number(size, 0)})
    return F.when(any_in(name, NAME_PATTERNS) | any_in(alt, ALT_KEYWORDS), BY_NAME).when(small, shown).otherwise("")


def drop_reason(uses: Column, rule: Column, captioned: Column) -> Column:
    """Why an image of a book is dropped, or an empty string: used too often, or by a rule; never with a caption near it."""
    often = X.fill(REPEATED, {"n": uses.cast("string")})
    return F.when(captioned, "").when(uses > MOST_USES, often).otherwise(rule)


_ALT = "case when page_id % 11 = 0 then 'Decorative line' when page_id % 13 = 0 then 'Our Logo' else regexp_extract(html, '<title>([^<]*)', 1) end"
_NAME = "case when page_id % 7 = 0 then 'images/cover' || page_id || '.jpg' else url end"


@query(f"""
with i as (select page_id, lower({_NAME}) as name, lower({_ALT}) as alt, length(html) as n, cast(page_id % 130 as int) as w, 200 as h, page_id % 9 + 1 as uses, page_id % 4 = 0 as captioned from pages),
r as (select page_id, uses, captioned, case when {" or ".join(f"contains(name, '{x}')" for x in NAME_PATTERNS)} or {" or ".join(f"contains(alt, '{x}')" for x in ALT_KEYWORDS)} then '{BY_NAME}'
  when n < {LEAST_BYTES} or (w > 0 and w < {LEAST_PX}) then 'reglas: muy pequeña (' || w || 'x' || h || 'px, ' || format('{{:,}}', n) || ' bytes)' else '' end as rule from i)
select page_id, rule, case when captioned then '' when uses > {MOST_USES} then 'reglas: repetida ' || uses || ' veces (viñeta/separador)' else rule end as dropped from r""")
def decorative_rule(spark: SparkSession, d: str) -> DataFrame:
    """Decoration by name, alternative text or size, and what of it is dropped; here pages stand for images."""
    p = table(spark, d, "pages")
    rule = rule_reason(F.expr(_NAME), F.expr(_ALT), F.length("html"), (F.col("page_id") % 130).cast("int"), F.lit(200))
    r = p.select("page_id", rule.alias("rule"), (F.col("page_id") % 9 + 1).alias("uses"), (F.col("page_id") % 4 == 0).alias("captioned"))
    return r.select("page_id", "rule", drop_reason(F.col("uses"), F.col("rule"), F.col("captioned")).alias("dropped"))


#: derived image files: headers of four kinds, a broken one, and zeros behind them
_W, _H, _TAIL = "(1 + page_id * 37 % 700)", "(1 + page_id * 53 % 900)", "(page_id * 97 % 9000)"


def _image_files(pages: DataFrame) -> DataFrame:
    """(page_id, content): image files whose bytes follow from the pages' ids."""
    w, h = F.expr(_W), F.expr(_H)
    big = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    little = lambda c, n: F.concat(*[F.substring(big(c, n), 2 * n - 2 * i - 1, 2) for i in range(n)])
    kinds = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0802000000")),
        F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("000000")),
        F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFFEFFC0"), F.repeat(F.lit("41"), 0xFFC0 - 2), F.lit("FFFFDB000411AAFFC2001108"), big(h, 2), big(w, 2), F.lit("03")),
        F.concat(F.lit("52494646000000005745425056503858"), F.lit("0A00000010000000"), little(w - 1, 3), little(h - 1, 3)),
        F.lit("FFD8FFDA0000"),
    ]
    pick = F.element_at(F.array(*kinds), (F.col("page_id") % 5 + 1).cast("int"))
    return pages.select("page_id", F.unhex(F.concat(pick, F.repeat(F.lit("00"), F.expr(_TAIL).cast("int")))).alias("content"))


_HEADS = "[29, 13, 65511, 30, 6]"


@query(f"""
with s as (select page_id, cast(page_id % 5 as int) as k, {_W} as w, {_H} as h, {_HEADS}[1 + cast(page_id % 5 as int)] + {_TAIL} as n from pages),
i as (select page_id, case when k = 4 then 0 else w end as width, case when k = 4 then 0 else h end as height, ['PNG', 'GIF', 'JPEG', 'WEBP', null][k + 1] as type, n as n_bytes from s)
select page_id, cast(width as int) as width, cast(height as int) as height, type, cast(n_bytes as bigint) as n_bytes, case when n_bytes < {LEAST_BYTES} or (width > 0 and (width < {LEAST_PX} or height < {LEAST_PX})) then 'reglas: muy pequeña (' || width || 'x' || height || 'px, ' || format('{{:,}}', n_bytes) || ' bytes)' else '' end as rule from i""")
def image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Sides, kinds and the rule of small images from the bytes of image files."""
    found = with_headers(_image_files(table(spark, d, "pages").select("page_id")))
    rule = rule_reason(F.lit(""), F.lit(""), F.col("n_bytes"), F.col("width"), F.col("height"))
    return found.withColumn("rule", rule)


def image_pages(images: DataFrame) -> DataFrame:
    """(xref, pages, first_page): on how many different pages an image stands."""
    return images.where("xref > 0").groupBy("xref").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("first_page"))


BUCKETS = 64  # parts that the places of an image are dealt by


def with_image_pages(images: DataFrame) -> DataFrame:
    """images with their image's `pages` and `first_page`, null where image_pages has none.

    Rows meet by image and part of the pages, so that an image that stands on every page is many tasks.
    """
    x = images.withColumn("__part", F.pmod(F.xxhash64("page"), F.lit(BUCKETS)))
    parts = x.where("xref > 0").select("xref", "__part").distinct().join(image_pages(images), "xref")  # of an image BUCKETS rows at most
    return x.join(parts, ["xref", "__part"], "left").drop("__part")


def page_scans(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages(page, n_chars, area) with `scanned`: little text, or an image that isn't a background covers nearly all of it; images(page, xref, area)."""
    seen = with_image_pages(images).withColumnRenamed("area", "covers")
    full = seen.where(F.coalesce("pages", F.lit(0)) <= MOST_PAGES).groupBy("page").agg(F.max("covers").alias("covers"))
    scanned = (F.col("n_chars") < SCANNED_CHARS) | (F.coalesce("covers", F.lit(0.0)) >= SCAN_SHARE * F.greatest(F.col("area"), F.lit(1.0)))
    return pages.join(full, "page", "left").withColumn("scanned", scanned).drop("covers")


_AREA = "(x1 - x0) * (y1 - y0)"


@query(f"""
with i as (select page, xref, {_AREA} as covers from spans), x as (select xref, count(distinct page) as pages from spans where xref > 0 group by xref),
f as (select page, max(covers) as covers from i left join x on i.xref = x.xref where coalesce(pages, 0) <= {MOST_PAGES} group by page)
select p.page, p.n < {SCANNED_CHARS} or coalesce(f.covers, 0) >= {SCAN_SHARE} * 4000 as scanned from (select page, sum(n_chars) as n from spans group by page) p left join f on f.page = p.page""")
def page_scanned(spark: SparkSession, d: str) -> DataFrame:
    """Scanned pages; here every span is also an image, and pages have 4000 square points."""
    s = table(spark, d, "spans")
    pages = s.groupBy("page").agg(F.sum("n_chars").alias("n_chars")).withColumn("area", F.lit(4000.0))
    return page_scans(pages, s.select("page", "xref", F.expr(_AREA).alias("area"))).select("page", "scanned")


def page_images(images: DataFrame, page_area: float) -> DataFrame:
    """images(page, xref, w, h, captioned) with the `reason` why each is dropped, or an empty string, and whether it is `listed`.

    captioned: whether its page has a caption, which halves the least side and lifts the least area. A repeated image is
    listed on its first page only.
    """
    x = with_image_pages(images)
    least = F.when(F.col("captioned"), LEAST_PT / 2).otherwise(float(LEAST_PT))
    often = F.coalesce("pages", F.lit(0)) > MOST_PAGES
    reason = (
        F.when((F.col("w") < least) | (F.col("h") < least) | (F.col("w") * F.col("h") <= 0), TOO_SMALL)
        .when(~F.col("captioned") & (F.col("w") * F.col("h") < LEAST_SHARE * page_area), SMALL_AREA)
        .when(often, X.fill(ON_PAGES, {"n": F.col("pages").cast("string")}))
        .otherwise("")
    )
    x = x.withColumn("reason", reason)
    listed = (F.col("reason") != "") & (~F.contains("reason", F.lit("repetida")) | (F.col("page") == F.col("first_page")))
    return x.withColumn("listed", listed).drop("pages", "first_page")


_SIZED = "select page, block, xref, 20.0 + l_size * 4 as w, 10.0 + n_chars as h, max(case when bold then 1 else 0 end) over (partition by page) = 1 as captioned from (select *, size as l_size from spans)"


@query(f"""
with i as ({_SIZED}), x as (select xref, count(distinct page) as pages, min(page) as first_page from spans where xref > 0 group by xref),
r as (select i.page, i.block, x.first_page, case when w < case when captioned then 36 else 72 end or h < case when captioned then 36 else 72 end then '{TOO_SMALL}' when not captioned and w * h < 0.02 * 484704 then '{SMALL_AREA}'
  when x.pages > 3 then 'reglas: repetida en ' || x.pages || ' páginas (logo/fondo)' else '' end as reason from i left join x on i.xref = x.xref)
select page, block, reason, reason <> '' and (not contains(reason, 'repetida') or coalesce(page = first_page, false)) as listed from r""")
def image_filter(spark: SparkSession, d: str) -> DataFrame:
    """Images on pages that rules drop; here spans stand for them, and a page with bold text has a caption."""
    s = table(spark, d, "spans")
    captioned = F.max(F.col("bold").cast("int")).over(W.partitionBy("page")) == 1
    i = s.select("page", "block", "xref", (20.0 + F.col("size") * 4).alias("w"), (10.0 + F.col("n_chars")).alias("h"), captioned.alias("captioned"))
    out = page_images(i, 612.0 * 792.0)
    return out.select("page", "block", "reason", F.coalesce("listed", F.lit(False)).alias("listed"))


def gathered(df: DataFrame, by: list[str], then: str, **of: Column) -> DataFrame:
    """A row for each group of df's rows, with aggregates: as groupBy, but rows sorted by `by` and `then` are taken as they are.

    Of groups within groups one sort is enough, where each groupBy that collects would sort its rows, before and after a shuffle.
    """
    w = W.partitionBy(*by).orderBy(then)
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return df.select(*by, *[c.over(every).alias(k) for k, c in of.items()], F.row_number().over(w).alias("__n")).where("__n = 1").drop("__n")


def page_texts(spans: DataFrame, tables: DataFrame, body: Column) -> DataFrame:
    """(page, text): pages as Markdown, from spans(page, block, line, x0, y0, x1, y1, size, bold, text) and tables(page, x0, y0, x1, y1, text).

    Lines of a block stay lines, with words cut at their ends joined; blocks of which more than half lies in a table go;
    headings are told by their size against that of the body; each table stands before the first block below it. All is
    gathered by page, which is small: spans are dealt by page once and sorted once, and those that are dealt so already stay.
    """
    sides = {"x0": F.min("x0"), "y0": F.min("y0"), "x1": F.max("x1"), "y1": F.max("y1")}
    solid = lambda c: F.when(X.strip(F.col("text")) != "", c)
    spans = spans.repartition("page").sortWithinPartitions("page", "block", "line", "x0")
    line = gathered(spans, ["page", "block", "line"], "x0", t=F.collect_list(F.struct("x0", "text")), **sides, size=F.max(solid(F.col("size"))), bold=F.min(solid(F.col("bold").cast("int"))))
    line = line.withColumn("t", X.strip(F.array_join(F.transform(F.array_sort("t"), lambda s: s["text"]), ""))).where("t <> ''")
    block = gathered(line, ["page", "block"], "line", l=F.collect_list(F.struct("line", "t")), **sides, size=F.max("size"), bold=F.min("bold")).withColumn("l", F.array_sort("l"))
    text = X.dehyphenate(F.array_join(F.transform("l", lambda s: s["t"]), "\n"))
    block = block.withColumn("text", text).withColumn("mark", X.heading(F.col("size"), body, F.length("text"), F.col("bold") == 1, F.size("l")))
    block = block.withColumn("text", F.when(F.col("mark") == "", F.col("text")).otherwise(F.concat("mark", F.translate("text", "\n", " "))))
    items = gathered(block, ["page"], "block", items=F.collect_list(F.struct("block", F.struct(F.col("y0").alias("y"), F.col("text").alias("label")).alias("s"), "x0", "x1", "y1")))
    boxes = tables.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("y0").alias("y"), F.col("text").alias("label"), "x0", "x1", "y1"))).alias("boxes"))

    def covered(x):
        side = lambda lo, hi, a, z: F.greatest(F.lit(0.0), F.least(hi, z) - F.greatest(lo, a))
        area = F.greatest((x["x1"] - x["x0"]) * (x["y1"] - x["s"]["y"]), F.lit(1.0))
        share = lambda b: side(x["x0"], x["x1"], b["x0"], b["x1"]) * side(x["s"]["y"], x["y1"], b["y"], b["y1"]) / area
        return F.exists("boxes", lambda b: share(b) > 0.5)

    left = F.filter(F.array_sort("items"), lambda x: ~F.coalesce(covered(x), F.lit(False)))
    both = items.join(boxes, "page", "full").select("page", F.coalesce(F.transform(left, lambda x: x["s"]), F.expr("cast(array() as array<struct<y:double,label:string>>)")).alias("items"), F.transform(F.coalesce("boxes", F.array()), lambda b: F.struct(b["y"].alias("y"), b["label"].alias("label"))).alias("tables"))
    return both.select("page", F.array_join(F.transform(with_tables(F.col("items"), F.col("tables")), lambda s: s["label"]), "\n\n").alias("text"))


_BLOCKS = "(select page, block, min(size) as size, bool_and(bold) as bold, min(n_chars) as n_chars, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from spans group by page, block)"


@query(f"""
with d as {_BLOCKS}, s as (select page, block, size, y0, 'block ' || block || ' of ' || page || case when block % 2 = 0 then '' else '-' || chr(10) end || case when block % 2 = 0 then 'low' else 'Up' end || repeat('x', n_chars) as t from d where block > 1),
b as (select page, block, y0, case when length(t) < 150 and size >= 6.75 then '# ' || replace(t, chr(10), ' ') when length(t) < 150 and size >= 5.75 then '## ' || replace(t, chr(10), ' ') else t end as t from s),
p as (select page, list({{'y': y0, 'label': t}} order by block) as items from b group by page),
t1 as (select page, {{'y': y0, 'label': '|table|'}} as t1 from d where block = 1),
j as (select coalesce(p.page, t1.page) as page, coalesce(p.items, []) as items, t1 from p full join t1 on p.page = t1.page), k as (select page, items, t1, coalesce(nullif(list_position(list_transform(items, lambda x: x.y > t1.y), true), 0), len(items) + 1) as at_ from j)
select page, md5(array_to_string(list_transform(case when t1 is null then items else list_concat(list_concat(list_slice(items, 1, at_ - 1), [t1]), list_slice(items, at_, len(items))) end, lambda x: x.label), chr(10) || chr(10))) as text_md5 from k""")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Pages put together from their spans; here blocks are two spans on two lines, and the first block's place is a table's."""
    of = {"size": F.min, "bold": F.bool_and, "n_chars": F.min, "x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    s = table(spark, d, "spans").select("page", "block", *of).repartition("page").groupBy("page", "block").agg(*[f(c).alias(c) for c, f in of.items()])
    line = F.explode(F.array(F.struct(F.lit(0).alias("line"), F.concat(F.lit("block "), "block", F.lit(" of "), "page", F.lit("-")).alias("text")), F.struct(F.lit(1).alias("line"), F.concat(F.when(F.col("block") % 2 == 0, "low").otherwise("Up"), F.expr("repeat('x', n_chars)")).alias("text"))))
    spans = s.where("block > 1").select("page", "block", line.alias("l"), "x0", "y0", "x1", "y1", "size", "bold").select("page", "block", "l.line", "x0", "y0", "x1", "y1", "size", "bold", "l.text")
    tables = s.where("block = 1").select("page", F.lit(0.0).alias("x0"), "y0", F.lit(0.0).alias("x1"), "y1", F.lit("|table|").alias("text"))
    return page_texts(spans, tables, F.lit(5.0)).select("page", F.md5("text").alias("text_md5"))
