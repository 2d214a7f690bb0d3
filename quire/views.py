"""Derived inputs as SQL that both Spark and DuckDB run, and a helper to run SQL over a folder of Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BAD = "\ue000\ue001\ufffd"

#: documents of a source lie in books of at most 1000 ids, so that no book grows with the table
_BOOK = "source || '/' || cast(cast(floor(doc_id / 1000.0) as bigint) as string)"

VIEWS = {
    "book_docs": f"select doc_id, text, lang, {_BOOK} as source, n_chars from documents",
    "documents_dirty": f"""
select doc_id, {_BOOK} as source, lang,
  case cast(doc_id % 8 as int)
    when 1 then text || chr(10) || 'Table ' || cast(doc_id % 9 + 1 as string) || '.2 Doses'
    when 2 then text || ' see ' || case cast(doc_id % 3 as int) when 0 then 'Table 3' when 1 then 'Chart 5' else 'Gráfica 2' end || ' for details'
    when 3 then text || case cast(doc_id % 3 as int) when 0 then ' target $7% or #45%' when 1 then ' take ##30 mg' else ' value ,63 g' end
    when 4 then text || '{BAD}'
    when 5 then replace(text, chr(10), '  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10))
    when 6 then translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'bcdefghijklmnopqrstuvwxyzaBCDEFGHIJKLMNOPQRSTUVWXYZA')
    when 7 then text || ' dose (,2,300 kcal) and .3,500 mg'
    else text || case when doc_id % 3 = 0 then chr(10) || 'xx yy zz ww xx yy zz ww; 12(3): 45' else '' end end as text
from documents""",
    "entries": """
select cast(floor(conv_id / 20.0) as bigint) as book_id, conv_id as unit_id, turn as pos,
  trim(substring('C01C02C03C04C05C06C07C08C09C10C11C12C13C14C15C16C17C18L1 L2 L3 L4 L5 ', cast(1 + 3 * ((conv_id * 7 + turn * 3) % 23) as int), 3)) as dest,
  replace(substring(text, 1, 24), chr(10), ' ') as title,
  text || chr(10) || 'tags: type:principle  condition:'
    || trim(substring('renal   diabetessop     general ', cast(1 + 8 * (conv_id % 4) as int), 8)) || ','
    || trim(substring('renal   diabetessop     general ', cast(1 + 8 * (turn % 4) as int), 8)) || ',bogus'
    || chr(10) || 'src: Ch ' || cast(conv_id as string) as body
from conversations""",
    "verify_ops": """
select conv_id as unit_id, turn as pos, case when (conv_id + turn) % 15 = 0 then turn + 60 when turn % 8 = 4 then turn - 3 else turn + 1 end as ordinal,
  case when turn % 4 = 0 then 'replace' when conv_id % 3 = 0 then 'delete' when turn % 4 = 2 then 'add' else 'log' end as op,
  case when turn % 4 = 0 then 'C09' when turn % 4 = 2 then 'X' || turn else 'C12' end as dest, 'checked ' || turn as title,
  'verified: ' || replace(text, chr(10), ' ') || ' with 77.5 mg of 12' as body
from conversations where (conv_id + turn) % 3 = 0""",
    "usage": """
select event_id,
  case event_type when 'signup' then 'MAP' when 'view' then 'EXTRACT' when 'click' then 'VERIFY' when 'purchase' then 'SYNTHESIS' else 'RETRY' end
    || ' U' || lpad(cast(user_id % 20 as string), 2, '0') as label,
  'm' || cast(user_id % 3 as string) as model, event_id % 2 = 1 as batch,
  cast(floor(value * 100) as bigint) as input, cast(floor(value * 10) as bigint) as cache_write,
  cast(floor(value * 1000) as bigint) as cache_read, cast(floor(value * 20) as bigint) as output, ts as time
from events""",
    "spans": """
select l_returnflag as book, l_orderkey as page, l_linenumber as block, round(l_quantity / 5, 1) as size,
  cast(l_partkey % 160 + 1 as int) as n_chars, l_returnflag = 'A' as bold, l_suppkey % 50 as xref,
  l_discount * 1000 as x0, l_tax * 1000 as y0, l_discount * 1000 + 72 as x1, l_tax * 1000 + l_quantity as y1
from lineitem""",
}


def duck(sql: str) -> str:
    """SQL over views as one statement for DuckDB."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{v} as ({VIEWS[v]})" for v in used)
    if sql.strip().lower().startswith("with recursive "):
        return f"with recursive {head}, {sql.strip()[15:]}"
    return f"with {head}, {sql.strip()[5:]}" if sql.strip().lower().startswith("with ") else f"with {head} {sql}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, or a view over them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    base = next(t for t in TABLES if re.search(rf"from {t}\b", sql))
    table(spark, sf_dir, base).createOrReplaceTempView(f"quire_{base}")
    return spark.sql(re.sub(rf"from {base}\b", f"from quire_{base}", sql))
