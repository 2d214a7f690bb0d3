"""URL filters: rules of host and path decide first; elsewhere the reputation of the host does, with DataFrame functions only.

Labelled outcomes of pages are counted for each host. A host's share of bad pages is drawn towards that of its registered
domain, this one's towards its suffix's, and this one's towards that of all pages, through beta priors whose weight is
estimated at each level from how much the groups differ beyond chance (empirical Bayes). A host is blocked where the
lower bound of its share's posterior is above a limit, so that few or mixed outcomes block nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_groups, materialise

MAX_RULES = 1_000  # rules are one expression of the plan
MAX_BAD = 0.5  # a host is blocked where its share of bad pages is surely above this one
Z = 1.645  # one-sided, 95 %
LEAST_WEIGHT, MOST_WEIGHT, PLAIN_WEIGHT = 1.0, 1000.0, 10.0  # bounds of a prior's weight in pages; that where nothing can be estimated

#: suffixes of two labels under which domains are registered; of all others the last label is the suffix
SUFFIXES = "ac.uk co.uk gov.uk org.uk com.au net.au org.au co.nz co.jp ne.jp or.jp co.kr com.br com.ar com.mx com.cn com.tw com.tr co.in co.za com.sg com.hk".split()

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty without :// or for a null."""
    rest = F.coalesce(F.try_element_at(F.split(url, "://", 2), F.lit(2)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without :// or for a null."""
    rest = F.coalesce(F.try_element_at(F.split(url, "://", 2), F.lit(2)), F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """A host without user, port and final dot."""
    return F.regexp_replace(host, r"^[^@]*@|:[0-9]*\z|\.\z", "")


def domain_of(name: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; an address of four numbers and a bare suffix stand for themselves."""
    short = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9]+(\.[0-9]+){3}$"), name).when(short.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(short)


def suffix_of(name: Column, suffixes: list[str] = SUFFIXES) -> Column:
    short = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.lit("")).when(short.isin(*suffixes), short).otherwise(F.substring_index(name, ".", -1))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), or null. Ties: the longer host, then block before allow.

    A rule (host, path, verdict) fits its host and all hosts below it whose path starts with the rule's. Beyond MAX_RULES an error.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = None
    for h, p, verdict in sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] != "block", r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def prior_weight(groups: DataFrame) -> float:
    """The weight, in pages, of the prior of groups (n, bad, mean): by the moments of what their counts differ from n * mean.

    The excess of the squared differences over chance gives the correlation of outcomes within a group.
    """
    chance = F.expr("n * mean * (1 - mean)")
    got = groups.where("n > 0").agg(F.sum(F.pow(F.expr("bad - n * mean"), 2) - chance).alias("excess"), F.sum(chance * F.expr("n - 1")).alias("most")).first()
    if not got["most"] or got["most"] <= 0:
        return PLAIN_WEIGHT
    rho = min(max(got["excess"] / got["most"], 1 / (MOST_WEIGHT + 1)), 1 / (LEAST_WEIGHT + 1))
    return round(1 / rho - 1, 6)


def _shrunk(groups: DataFrame) -> DataFrame:
    """Groups (n, bad, mean of the level above) with alpha and beta of their posterior, and its mean in place of the one above."""
    w = prior_weight(groups)
    a, b = F.expr(f"{w}D * mean + bad"), F.expr(f"{w}D * (1 - mean) + n - bad")
    return groups.withColumn("alpha", a).withColumn("beta", b).withColumn("mean", F.expr("alpha / (alpha + beta)"))


def reputations(urls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row for each host of urls (id, host): (host, rows, n_labelled, n_bad, bad_mean, bad_bound), written to the shared folder.

    outcomes: (id, bad boolean). An id with any bad outcome is bad, a null outcome is none, a null id has none; a page counts
    once for a host, however often it is repeated. Hosts without outcomes have the posterior of their domain.
    """
    own = urls.groupBy("id", "host").agg(F.count("*").alias("rows"))  # a hot id or host is one row here
    told = outcomes.groupBy("id").agg(F.max(F.col("bad").cast("int")).alias("bad")).where("id is not null and bad is not null")
    hosts = own.join(told, "id", "left").groupBy("host").agg(F.sum("rows").alias("rows"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    name = name_of(F.col("host"))
    hosts = materialise(hosts.withColumn("domain", domain_of(name)).withColumn("suffix", suffix_of(name)), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    mean = (total["bad"] + 0.5) / (total["n"] + 1)
    sums = F.sum("n").alias("n"), F.sum("bad").alias("bad")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.count("*").alias("below"), *sums), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.count("*").alias("below"), *sums).withColumn("mean", F.lit(mean)), "suffixes")
    suffixes = materialise(_shrunk(suffixes).select("suffix", "below", "mean"), "suffixes")
    above = join_groups(domains.withColumnRenamed("below", "hosts"), suffixes, "suffix", "below").select("domain", "hosts", "n", "bad", "mean")
    domains = materialise(_shrunk(materialise(above, "domains")).select("domain", "hosts", "mean"), "domains")
    hosts = materialise(join_groups(hosts, domains, "domain", "hosts").select("host", "rows", "n", "bad", "mean"), "hosts")
    bound = F.expr(f"mean - {Z}D * sqrt(mean * (1 - mean) / (alpha + beta + 1))")
    shrunk = _shrunk(hosts).select("host", "rows", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), F.round("mean", 6).alias("bad_mean"), F.round(F.greatest(bound, F.lit(0.0)), 6).alias("bad_bound"))
    return materialise(shrunk, "hosts")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", max_bad: float = MAX_BAD) -> DataFrame:
    """pages with (host, path, rule, verdict, n_labelled, n_bad, bad_mean, bad_bound), which replace columns of those names.

    outcomes: (id, bad boolean) of labelled pages, by their ids. A null or odd url has an empty host and path, and the
    reputation of the empty host. Repeated rows are rows of their own, an empty table gives no rows; an id may be null. A
    host of a third of all rows is dealt over several tasks. Long urls are read whole.
    """
    added = ["host", "path", "rule", "verdict", "n_labelled", "n_bad", "bad_mean", "bad_bound"]
    url = F.col(url_col).cast("string")
    rows = pages.select(*[c for c in pages.columns if c not in added], *[e.alias(f"__url_{k}") for k, e in (("id", F.col(id_col)), ("host", host_of(url)), ("path", path_of(url)))])
    told = reputations(rows.select(F.col("__url_id").alias("id"), F.col("__url_host").alias("host")), outcomes)
    told = told.select(F.col("host").alias("__url_host"), F.col("rows").alias("__url_rows"), *added[4:])
    rows = join_groups(rows, told, "__url_host", "__url_rows").withColumn("__url_rule", fitting_rule(F.col("__url_host"), F.col("__url_path"), rules))
    own = F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")
    rows = rows.withColumn("host", F.col("__url_host")).withColumn("path", F.col("__url_path")).withColumn("rule", F.col("__url_rule.rule"))
    return rows.withColumn("verdict", F.coalesce("__url_rule.verdict", own)).drop("__url_id", "__url_host", "__url_path", "__url_rule")


def keep_allowed(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", max_bad: float = MAX_BAD) -> DataFrame:
    """The rows of pages whose verdict is allow, with the columns of pages; as `judge` in all else."""
    kept = pages.withColumn("__page", F.struct(*pages.columns)).select(F.col(id_col).alias("__page_id"), F.col(url_col).alias("__page_url"), "__page")
    return judge(kept, outcomes, rules, "__page_id", "__page_url", max_bad).where("verdict = 'allow'").select("__page.*")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes (id, bad) of labels (doc_id, quality, toxic): bad where toxic or of low quality, null where both are null."""
    return labels.select(F.col("doc_id").alias("id"), (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"), "quality", "toxic").where(
        "quality is not null or toxic is not null").select("id", "bad")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; labels tell the outcomes of the pages with their ids."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, page_outcomes(spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop("url")


def _oracle() -> str:
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    fits = " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{{}}'".format(h + p) for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
    rules = " ".join(f"when '{h}{p}' then '{v}'" for h, p, v in RULES)

    def weight(groups: str) -> str:
        chance = "n * mean * (1 - mean)"
        rho = f"sum(pow(bad - n * mean, 2) - {chance}) / sum({chance} * (n - 1))"
        return f"(select case when coalesce(sum({chance} * (n - 1)), 0) <= 0 then {PLAIN_WEIGHT} else round(1 / least(greatest({rho}, {1 / (MOST_WEIGHT + 1)!r}), {1 / (LEAST_WEIGHT + 1)!r}) - 1, 6) end from {groups} where n > 0)"

    def shrunk(groups: str) -> str:
        return f"(select *, w * mean + bad as alpha, w * (1 - mean) + n - bad as beta from (select *, cast({weight(groups)} as double) as w from {groups}))"

    return f"""
with t as (select doc_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels where quality is not null or toxic is not null group by doc_id),
r as (select page_id, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{SMALL}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
h as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad, regexp_replace(host, '^[^@]*@|:[0-9]*\\z|\\.\\z', '', 'g') as name from (select distinct page_id, host from u) left join t on doc_id = page_id group by host),
k as (select *, string_split(name, '.') as l, regexp_matches(name, '^[0-9]+(\\.[0-9]+){{3}}$') as ip from h),
d as (select *, case when ip then name when array_to_string(l[-2:], '.') in ({two}) then array_to_string(l[-3:], '.') else array_to_string(l[-2:], '.') end as domain,
  case when ip then '' when array_to_string(l[-2:], '.') in ({two}) then array_to_string(l[-2:], '.') else l[-1] end as suffix from k),
s1 as (select suffix, sum(n) as n, sum(bad) as bad, (select (sum(bad) + 0.5) / (sum(n) + 1) from d) as mean from d group by suffix),
s2 as (select suffix, alpha / (alpha + beta) as mean from {shrunk("s1")}),
d1 as (select domain, sum(n) as n, sum(bad) as bad, any_value(mean) as mean from d join s2 using (suffix) group by domain),
d2 as (select domain, alpha / (alpha + beta) as mean from {shrunk("d1")}),
h1 as (select host, n, bad, mean from d join d2 using (domain)),
h2 as (select host, n, bad, alpha / (alpha + beta) as m, alpha + beta as ab from {shrunk("h1")}),
o as (select page_id, host, path, case {fits} end as rule, cast(n as bigint) as n_labelled, cast(bad as bigint) as n_bad, round(m, 6) as bad_mean, round(greatest(m - {Z} * sqrt(m * (1 - m) / (ab + 1)), 0), 6) as bad_bound from u join h2 using (host))
select page_id, host, path, rule, coalesce(case rule {rules} end, case when bad_bound > {MAX_BAD} then 'block' else 'allow' end) as verdict, n_labelled, n_bad, bad_mean, bad_bound from o"""


QUERIES = {"op11_url_filter": op11_url_filter}
ORACLES = {"op11_url_filter": _oracle()}
