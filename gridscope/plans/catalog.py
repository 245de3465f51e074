"""Queries over the driver's tables, one or more for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.functions import text as T
from gridscope.functions.regions import dictionary
from gridscope.operators import bands, bulk, rules, scoring
from gridscope.plans import rule_queries
from gridscope.plans.report import summaries
from gridscope.sources import files, relational
from gridscope.sources.tables import context

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SP = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"
_RUNS = r"[ \x{3000}]{2,}"


@query(
    f"""select doc_id, t <> {_STRIP('t')} as edge, contains(text, chr(12288)) as wide, regexp_matches({_STRIP('text')}, '{_RUNS}') as run,
    regexp_matches(regexp_replace(text, '[\\r\\n]+$', ''), '[\\r\\n]') and (length(text) - length(regexp_replace(text, '{_SP}', '', 'g'))) / greatest(length(text), 1) > 0.10 as newline
    from (select doc_id, text, regexp_replace(text, '\\n+$', '') as t from documents where text is not null)"""
)
def whitespace_cells(spark, sf_dir):
    found = rules.whitespace_issues(F.col("text"))
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", *[F.array_contains(found, k).alias(k) for k in ("edge", "wide", "run", "newline")])


@query(
    r"""select doc_id, turn_no, why from (select conv_id as doc_id, turn as turn_no, case
      when contains(text, chr(10)) and len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '')) >= 2 then 'lines'
      when regexp_matches(text, '^\s*\d+（\d+）\s*$') then 'two measures'
      when length(text) - length(replace(text, '、', '')) >= 2 then 'enumeration'
      when length(text) - length(replace(text, '・', '')) >= 2 then 'enumeration by dots'
      when regexp_matches(text, '(^|[^0-9]),([^0-9]|$)') and not regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^\d{1,3}(,\d{3})*(\.\d+)?$') then 'commas'
      when contains(regexp_replace(text, '（[^）]*）', '', 'g'), ',') and not regexp_matches(regexp_replace(regexp_replace(text, '\s+', '', 'g'), '（[^）]*）', '', 'g'), '^\d{1,3}(,\d{3})*(\.\d+)?$') then 'commas' end as why
      from conversations where text is not null) where why is not null"""
)
def multi_data_cells(spark, sf_dir):
    return read(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("turn_no"), rules.several_data(F.col("text")).alias("why")).where("why is not null")


_MARKED = "text || case doc_id % 7 when 0 then '①' when 1 then 'Ⅲ' when 2 then '㎏' when 3 then 'Ａ' when 4 then '～' when 5 then '㈱' else '' end"


@query(
    rf"""select doc_id, case when regexp_matches(t, '[\x{{2460}}-\x{{2473}}\x{{3251}}-\x{{325F}}\x{{32B1}}-\x{{32BF}}]') or regexp_matches(regexp_replace(t, '[㎡㎥㎢㎠㎝㎞㎜㎏㎎㎍㎅㎄㎃㎖㎗㎘㏄㏊]', '', 'g'), '[\x{{3220}}-\x{{3243}}\x{{3280}}-\x{{32FF}}\x{{3300}}-\x{{33FF}}\x{{FE30}}-\x{{FE4F}}〜～]') or regexp_matches(t, '[\x{{2160}}-\x{{217F}}]') then 'warning'
      when regexp_matches(t, '[\x{{FF10}}-\x{{FF19}}\x{{FF21}}-\x{{FF3A}}\x{{FF41}}-\x{{FF5A}}]') then 'info' end as severity from (select doc_id, {_MARKED} as t from documents where text is not null)"""
)
def char_class_cells(spark, sf_dir):
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", rules.platform_severity(F.expr(_MARKED)).alias("severity"))


@query(
    """select l_suppkey, count(*) as filled, count(v) as numbers, count(*) filter (where v = 0) as zeros, sum(blank) as blanks from (
      select l_suppkey, l_tax as v, case when l_linenumber = 1 then 1 else 0 end as blank from lineitem) where blank = 0 or blank = 1 group by l_suppkey having count(v) >= 0.7 * count(*) and sum(blank) > 0 and count(*) filter (where v = 0) >= 2"""
)
def blank_zero_candidates(spark, sf_dir):
    v = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_tax").alias("v"), F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("blank"))
    n = v.groupBy("l_suppkey").agg(F.count("*").alias("filled"), F.count("v").alias("numbers"), F.count_if(F.col("v") == 0).alias("zeros"), F.sum("blank").alias("blanks"))
    return n.where("numbers >= 0.7 * filled and blanks > 0 and zeros >= 2")


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_KIND = r"case when {c} is null or {c} in ('', '-', 'x', 'X', 'N/A', 'n/a', 'NA', '*') then 'empty' when regexp_matches({c}, '^\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}$|^\d{{1,2}}[-/]\d{{1,2}}[-/]\d{{4}}$') then 'date' when regexp_matches({c}, '^[+-]?\d+$|^[+-]?\d+\.\d+$|^[+-]?\d{{1,3}}(,\d{{3}})*(\.\d+)?$') then 'numeric' else 'text' end"


def _types_sql() -> str:
    kind = {"o_orderkey": "'numeric'", "o_custkey": "'numeric'", "o_totalprice": "'numeric'", "o_orderdate": "'date'"}
    parts = [f"select {i} as col, {kind.get(c, _KIND.format(c=c))} as k from orders" for i, c in enumerate(_ORDERS, 1)]
    return f"""select col, n_numeric, n_date, n_text, n_empty, case when n_numeric + n_date + n_text = 0 then 'empty' when n_numeric >= 0.8 * (n_numeric + n_date + n_text) then 'numeric' when n_date >= 0.8 * (n_numeric + n_date + n_text) then 'date' when n_text >= 0.8 * (n_numeric + n_date + n_text) then 'text' else 'mixed' end as ctype
      from (select col, count(*) filter (where k = 'numeric') as n_numeric, count(*) filter (where k = 'date') as n_date, count(*) filter (where k = 'text') as n_text, count(*) filter (where k = 'empty') as n_empty from ({' union all '.join(parts)}) group by col)"""


@query(_types_sql())
def column_types(spark, sf_dir):
    cells = relational.cells(read(spark, sf_dir, "orders").select(*_ORDERS), "orders", ["o_orderkey"]).where("row > 1")
    return bands.column_kinds(cells, ["col"], T.value_kind(F.col("vtype"), F.col("vtext")))


@query("select row, u.col, u.vtype, u.vtext from (select *, row_number() over (order by n_nationkey) + 1 as row from nation), unnest([{'col': 1, 'vtype': 'num', 'vtext': n_nationkey::varchar}, {'col': 2, 'vtype': 'str', 'vtext': n_name}, {'col': 3, 'vtype': 'num', 'vtext': n_regionkey::varchar}]) as t(u)")
def adapter_cells(spark, sf_dir):
    return relational.cells(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation", ["n_nationkey"]).where("row > 1").select(F.col("row").cast("long").alias("row"), "col", "vtype", "vtext")


@query("select l_suppkey, min(l_partkey) as start, max(l_partkey) as \"end\", count(*) as n, island from (select *, sum(new) over (partition by l_suppkey order by l_partkey rows unbounded preceding) as island from (select *, case when l_partkey - lag(l_partkey) over (partition by l_suppkey order by l_partkey) <= 1 then 0 else 1 end as new from (select distinct l_suppkey, l_partkey from lineitem))) group by l_suppkey, island")
def band_split(spark, sf_dir):
    return bands.islands(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey").select("l_suppkey", "start", "end", "n", "island")


@query("select o_custkey, min(i) as start, max(i) as \"end\", count(*) as n from (select o_custkey, i, i - row_number() over (partition by o_custkey order by i) as g from (select distinct o_custkey, o_orderkey // 64 as i from orders)) group by o_custkey, g")
def hidden_groups(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", F.floor(F.col("o_orderkey") / 64).alias("i"))
    return bands.islands(o, ["o_custkey"], "i").drop("island")


@query("select l_orderkey, i as l_linenumber from (select l_orderkey, max(l_linenumber) as m from lineitem group by l_orderkey), unnest(range(1, m::bigint + 1)) as t(i) where (l_orderkey, i) not in (select l_orderkey, l_linenumber from lineitem where l_returnflag = 'N')")
def blank_rows(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_returnflag") == "N").alias("present"))  # noqa: E741
    spans = l.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    return bands.missing_indices(spans, l.where("present"), ["l_orderkey"], "l_linenumber", F.lit(1).cast("long"), F.col("m"))


@query("select l_suppkey, sum(n) / (count(*) * 4.0)::double as fill_rate, count(*) filter (where n >= 1.2) / count(*)::double as row_rate from (select l_suppkey, l_orderkey, count(*) filter (where l_discount > 0.02) as n from lineitem group by all) group by l_suppkey")
def region_fill(spark, sf_dir):
    return bands.fill_rates(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", F.col("l_discount") > 0.02, 4).drop("confidence")


_AMOUNT = "case when p_partkey % 7 = 0 then cast(p_size as {s}) || 'kg' when p_partkey % 7 = 1 then cast(p_size as {s}) || '%' when p_partkey % 7 = 2 then cast(p_size as {s}) || ' (x)' when p_partkey % 7 = 3 then '▲' || cast(p_size as {s}) when p_partkey % 7 = 4 then 'none' when p_partkey % 7 = 5 then 'a' || cast(p_size as {s}) else cast(p_size as {s}) end"


@query(
    rf"""select p_partkey, case when regexp_matches(s, '^[\s\-ー−]*[\d,]+\.?\d*\s*$') or regexp_matches(s, '^[^\d]+$') then null when regexp_matches(s, '^[▲△▼]\s*[\d,]+\.?\d*\s*$') then 'triangle'
      when regexp_matches(s, '^([\d,.]+)\s*(kg|km|m|g|t|ha)$') then 'unit' when regexp_matches(s, '^([\d,.]+)\s*(%|％)$') then 'percent' when regexp_matches(s, '^([\d,.]+)\s*[\(（].*[\)）]$') then 'note' else 'other' end as why from (select p_partkey, {_AMOUNT.format(s='varchar')} as s from part)"""
)
def numeric_purity(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", rules.impurity(F.expr(_AMOUNT.format(s="string")), F.lit(False)).alias("why"))


_ITEM = "case when l_quantity > 35 then '' when l_quantity > 25 then '同上' else l_returnflag end"


@query(f"select l_orderkey, l_linenumber, v, coalesce(max(case when v <> '' and v <> '同上' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber rows between unbounded preceding and 1 preceding), 0) = 1 as after from (select l_orderkey, l_linenumber, max({_ITEM}) as v from lineitem group by all)")
def abbreviation_gap(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.expr(_ITEM)).alias("v"))  # noqa: E741
    return l.withColumn("after", rules.after_value(F.col("v"), F.col("v").isin(rules.DITTO), ["l_orderkey"], "l_linenumber"))


_ANSWER = "case when o_orderkey % 97 = 0 then 'その他' || cast(o_orderkey % 5 as {s}) when o_orderkey % 193 = 0 then o_orderpriority || '※1' else o_orderpriority end"
_CHOICES = f"""select *, n <= 2 and n::double / rows <= 0.05 as rare from (select part, v, n, row, sum(n) over (partition by part)::bigint as rows, count(*) over (partition by part) as kinds from (
      select o_custkey % 50 as part, {_ANSWER.format(s='varchar')} as v, count(*) as n, min(o_orderkey) as row from orders group by all)) where rows >= 20 and kinds <= 20"""


def _answers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("part"), F.expr(_ANSWER.format(s="string")).alias("v"), F.col("o_orderkey").alias("row"))
    return rules.choice_values(o, ["part"], "v")


@query(_CHOICES)
def choice_outliers(spark, sf_dir):
    return _answers(spark, sf_dir)


@query(f"""with c as ({_CHOICES}) select a.part, a.v, u.v as usual from c a join c u on a.part = u.part and a.rare and not u.rare
      and (a.v = u.v || '※1' or u.v = a.v || '※1' or starts_with(a.v, 'その他') and starts_with(u.v, 'その他'))""")
def choice_variants(spark, sf_dir):
    v = _answers(spark, sf_dir)
    usual = v.where(~F.col("rare")).select("part", F.col("v").alias("usual"))
    return v.where("rare").join(usual, "part").where(rules.same_choice("v", "usual")).select("part", "v", "usual")


@query(f"select part, v, n, row, forms from (select *, count(*) over (partition by part) as forms from ({_CHOICES}) where contains(v, 'その他')) where forms >= 2 and n < 3")
def other_detail(spark, sf_dir):
    return rules.other_details(_answers(spark, sf_dir), ["part"], "v").select("part", "v", "n", "row", "forms")


@query("select s_suppkey, count(*) as n, min(l_orderkey) as first from supplier join lineitem on l_suppkey = s_suppkey and l_linenumber between s_nationkey % 3 + 1 and s_nationkey % 3 + 3 and l_partkey between s_nationkey * 4 and s_nationkey * 8 + 100 group by s_suppkey")
def point_in_region(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % 3 + 1).alias("r0"), (F.col("s_nationkey") % 3 + 3).alias("r1"), (F.col("s_nationkey") * 4).alias("c0"), (F.col("s_nationkey") * 8 + 100).alias("c1"))
    met = read(spark, sf_dir, "lineitem").join(s, "l_suppkey").where("l_linenumber between r0 and r1 and l_partkey between c0 and c1")
    return met.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


_HEADERS = [(f, i, h) for f, hs in {
    "a": "region 2019 2020 2021年 2022 note", "b": "name q_1 q_2 q_3 q_4 total", "c": "地域 1月 2月 3月 売上（円） 利益", "d": "item_id price 数量 面積 weight(kg) 重さ（kg）", "e": "H30 R01 R02 令和3年 x 120",
}.items() for i, h in enumerate(hs.split(), 1)]
_VALUES = "(values " + ", ".join(f"('{f}', {i}, '{h}')" for f, i, h in _HEADERS) + ") as heads(f, col, s)"


def _heads(spark) -> DataFrame:
    return spark.createDataFrame(_HEADERS, "f string, col int, s string")


@query(rf"""select f, kind, n, c0, c1 from (select *, row_number() over (partition by f order by kind) as k from (select f, kind, count(*) as n, min(col) as c0, max(col) as c1 from (select *, case when regexp_matches(s, '^(19|20)\d{{2}}\s*(年|年度)?$') then '1 year' when regexp_matches(s, '^(\d{{1,2}})\s*月$') then '2 month'
      when regexp_matches(s, '^(第?\d+[期回]|(上|下|前|後)半期?|[1-4]Q|Q[1-4]|[上下]期)$') then '3 term' when regexp_matches(s, '^(平成|令和|昭和)(\d{{1,2}}|元)\s*(年|年度)?$|^[RHS]\d{{1,2}}$') then '4 era' end as kind from {_VALUES}) where kind is not null group by all having count(*) >= 3)) where k = 1""")
def wide_headers(spark, sf_dir):
    return rules.wide_headers(_heads(spark), ["f"]).select("f", "kind", "n", "c0", "c1")


@query(rf"select f, base, count(*) as n, min(col) as c0, max(col) as c1 from (select f, col, regexp_extract(s, '^(.+?)[\s_\-]?(\d+)$', 1) as base, count(*) over (partition by f) as heads from {_VALUES}) where heads >= 5 and base <> '' and not regexp_matches(base, '^\d+$') group by all having count(*) >= 4")
def numbered_headers(spark, sf_dir):
    return rules.numbered_headers(_heads(spark), ["f"])


@query(f"select f, s, s in ('2019', '2020', '2022', '売上（円）', '面積', 'weight(kg)', '重さ（kg）', 'name', 'item_id', '120') as named from {_VALUES}")
def unit_columns(spark, sf_dir):
    return _heads(spark).select("f", "s", rules.names_unit(F.col("s")).alias("named"))


_WHEN = "case o_orderkey % 8 when 0 then {iso} when 1 then {slash} when 2 then {kanji} when 3 then 'H30.1.2' when 4 then '令和3年' when 5 then '03/04/01' when 6 then {year} || '年度' else {year} || '年度末 1' end"
_IN_SPARK = _WHEN.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", slash="date_format(o_orderdate, 'yyyy/M/d')", kanji="date_format(o_orderdate, 'yyyy年M月d日')", year="date_format(o_orderdate, 'yyyy')")
_IN_DUCK = _WHEN.format(iso="strftime(o_orderdate, '%Y-%m-%d')", slash="strftime(o_orderdate, '%Y/%-m/%-d')", kanji="strftime(o_orderdate, '%Y年%-m月%-d日')", year="strftime(o_orderdate, '%Y')")


@query(
    rf"""select o_orderkey, v, case when regexp_matches(v, '^[MTSHR]\d{{1,2}}\.\d{{1,2}}\.\d{{1,2}}$') then 'jis_era' when regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}$') then 'iso_date' when regexp_matches(v, '(明治|大正|昭和|平成|令和|M|T|S|H|R)\s*(\d{{1,2}})\s*(年|\.|-|/)') then 'era' when regexp_matches(v, '^\d{{2}}/\d{{1,2}}/\d{{1,2}}$') then 'vague'
      when regexp_matches(v, '^(19|20)\d{{2}}\s*年度') then 'fiscal_year' when regexp_matches(v, '^(19|20)\d{{2}}(年\d{{1,2}}月(\d{{1,2}}日)?|/\d{{1,2}}(/\d{{1,2}})?)$') then case when contains(v, '年') then 'kanji' else 'slash' end when regexp_matches(v, '^(19|20)\d{{2}}\s*(年|/|-|\.)') then 'western' end as form from (select o_orderkey, {_IN_DUCK} as v from orders)"""
)
def time_axis_labels(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.expr(_IN_SPARK).alias("v")).withColumn("form", rules.time_form(F.col("v")))


_PLACE = "case c_custkey % 5 when 0 then '東京' when 1 then '東京都' when 2 then '札幌' when 3 then '札幌市' else 'x' end"


@query(f"select c_custkey, case p when '東京' then 'short' when '東京都' then 'full' when '札幌' then 'alias' when '札幌市' then 'full' end as kind from (select c_custkey, {_PLACE} as p from customer) where p <> 'x'")
def region_names(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.expr(_PLACE).alias("name"))
    return c.join(F.broadcast(dictionary(spark)), "name").select("c_custkey", F.when(F.col("full"), "full").when(F.col("short"), "short").otherwise("alias").alias("kind"))


_FILES = "select p_size as batch, p_brand as file_id, list_sort(list(distinct split_part(p_type, ' ', 1))) as headers from part group by all"
_PAIRS = "select a.batch as batch, a.file_id as a, b.file_id as b, len(list_intersect(a.headers, b.headers))::double / len(list_distinct(list_concat(a.headers, b.headers))) as jaccard from kinds a join kinds b on a.batch = b.batch and a.file_id < b.file_id"


def _files(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("batch"), F.col("p_brand").alias("file_id")).agg(F.array_sort(F.collect_set(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("headers"))


@query(f"with files as ({_FILES}), kinds as (select batch, headers, min(file_id) as file_id from files group by all) {_PAIRS}")
def format_jaccard(spark, sf_dir):
    return bulk.pairs(_files(spark, sf_dir), ["batch"]).select("batch", "a", "b", "jaccard")


@query(f"with files as ({_FILES}), kinds as (select batch, headers, min(file_id) as file_id from files group by all), pairs as ({_PAIRS}) select f.batch as batch, count(*) as files, round(stddev_pop(len(headers)), 9) as spread, (select min(jaccard) from pairs p where p.batch = f.batch) as jaccard from files f group by f.batch")
def format_consistency(spark, sf_dir):
    h = _files(spark, sf_dir)
    p = bulk.pairs(h, ["batch"]).groupBy("batch").agg(F.min("jaccard").alias("jaccard"))
    return h.groupBy("batch").agg(F.count("*").alias("files"), F.round(F.stddev_pop(F.size("headers")), 9).alias("spread")).join(p, "batch", "left")


_CHECKS = "select cast(l_suppkey % 20 as {s}) as file_id, cast(l_partkey % 3 as int) as sheet_ix, cast(l_linenumber % 2 as int) as region_ix, 'R' || cast(l_linenumber as {s}) as rule_id, cast(l_orderkey % 3 + 1 as int) as level, l_quantity > 1 as passed, case cast(l_quantity + l_partkey as int) % 4 when 0 then 'critical' when 1 then 'major' when 2 then 'minor' else case when l_partkey % 50 = 0 then 'fatal' else 'info' end end as severity, case when l_tax = 0 then 0.0 else 1.0 end as confidence from lineitem"
_SCORED = f"""with c as ({_CHECKS.format(s='varchar')}), m as (select *, not passed and severity = 'fatal' as forced, case when not passed then case severity when 'critical' then [10, 40, 15][level] when 'major' then [5, 30, 10][level] when 'minor' then [2, 10, 5][level] else 0 end else 0 end as taken from c where confidence > 0)
      select case grouping(sheet_ix, region_ix) when 0 then 'table' when 1 then 'sheet' else 'file' end as grain, file_id, sheet_ix, region_ix, level, case when bool_or(forced) then 0 else greatest(0, 100 - sum(taken)) end::bigint as score, bool_or(forced) as forced_zero, count(*) as n_checks, count(*) filter (where not passed) as n_failed
      from m group by grouping sets ((file_id, level, sheet_ix, region_ix), (file_id, level, sheet_ix), (file_id, level))"""


def _checks(spark, sf_dir) -> DataFrame:
    return spark.sql(_CHECKS.format(s="string").replace("from lineitem", "from {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))


@query(_SCORED)
def level_scores(spark, sf_dir):
    return scoring.scores(_checks(spark, sf_dir)).drop("failed_rules", "forced_rules")


@query(f"select file_id, round_even(avg(score), 0)::int as mean_score from ({_SCORED}) where grain = 'file' group by file_id")
def file_means(spark, sf_dir):
    return bulk.file_means(scoring.scores(_checks(spark, sf_dir)).where("grain = 'file'"))


@query(f"select b as batch_id, round_even(avg(mean_score) * 0.7 + 0.5 * 100 * 0.3, 0)::int as total_score from (select file_id, file_id::int % 4 as b, round_even(avg(score), 0)::int as mean_score from ({_SCORED}) where grain = 'file' group by file_id) group by b")
def bulk_total(spark, sf_dir):
    means = bulk.file_means(scoring.scores(_checks(spark, sf_dir)).where("grain = 'file'")).withColumn("batch_id", F.col("file_id").cast("int") % 4)
    checks = spark.createDataFrame([(b, p, 1.0) for b in range(4) for p in (True, False)], "batch_id int, passed boolean, confidence double")
    return bulk.total(means, checks, ["batch_id"])


_FOUND = "select l_suppkey % 300 as k, cast(l_linenumber as int) as start_row, cast(l_partkey % 20 + 1 as int) as start_col, cast(l_linenumber + l_partkey % 2 as int) as end_row, cast(l_partkey % 20 + 1 as int) as end_col, case when l_discount > 0.05 then 'error' else 'warning' end as severity, l_returnflag as detail from lineitem where l_orderkey % 40 = 0"


def _violations(spark, sf_dir) -> DataFrame:
    return spark.sql(_FOUND.replace("from lineitem", "from {lineitem}"), lineitem=read(spark, sf_dir, "lineitem"))


@query(f"select k, severity, count(*) as n, min(start_row) as first_row from ({_FOUND}) group by all")
def violation_groups(spark, sf_dir):
    return scoring.violation_groups(_violations(spark, sf_dir), ["k"]).select("k", "severity", "n", F.col("samples")[0]["start_row"].alias("first_row"))


@query(f"""with v as (select *, chr(64 + start_col) || start_row || case when end_row > start_row then ':' || chr(64 + end_col) || end_row else '' end as place from ({_FOUND})), g as (select k, count(*) as n, list(place order by start_row, start_col, place, detail, severity) as places, list(severity order by start_row, start_col, place, detail, severity) as severities, count(*) filter (where severity = 'error') as e, count(*) filter (where severity = 'warning') as w from v group by k)
      select k, n, case when n > 20 then array_to_string(places[1:3], '; ') || ' and more, ' || n || ' in all' else array_to_string(places, '; ') end as places, case when n > 20 then array_to_string(list_filter([case when e > 0 then 'error: ' || e end, case when w > 0 then 'warning: ' || w end], lambda x: x is not null), '; ') else array_to_string(severities, '; ') end as severities from g""")
def report_summaries(spark, sf_dir):
    return summaries(_violations(spark, sf_dir), ["k"]).select("k", "n", "places", "severities")


_TABLES = "select o_custkey as file_id, o_orderkey as table_ix, cast(o_orderkey % 40 as int) as start_row, cast(o_orderkey % 40 + o_custkey % 3 as int) as end_row, 1 as start_col, cast(o_orderkey % 2 as int) as end_col, o_orderstatus = 'F' as labelled from orders"


@query(f"with t as ({_TABLES}) select file_id, table_ix, above_ix from (select b.file_id, b.table_ix, a.table_ix as above_ix, row_number() over (partition by b.file_id, b.table_ix order by a.end_row desc, a.table_ix) as k from t b join t a using (file_id, start_col, end_col) where not b.labelled and a.labelled and b.start_row - a.end_row - 1 between 0 and 2) where k = 1")
def header_inherit_asof(spark, sf_dir):
    return bands.nearest_above(spark.sql(_TABLES.replace("from orders", "from {orders}"), orders=read(spark, sf_dir, "orders")), ["file_id"])


@query("select 'r' || n_regionkey || '.csv' as file_id, r::int as row, u.col, u.v as vtext from (select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as r, n_nationkey, n_name from nation), unnest([{'col': 1, 'v': n_nationkey::varchar}, {'col': 2, 'v': n_name || ', \"x\"'}]) as t(u)")
def csv_cells(spark, sf_dir):
    n = read(spark, sf_dir, "nation").withColumn("line", F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit(', ""x"""')))
    given = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))).alias("l")).select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.encode(F.array_join(F.transform("l", lambda x: x["line"]), "\r\n"), "utf-8").alias("content"))
    return files.Workbooks(files.parse_files(given)).cells.select("file_id", "row", "col", "vtext")


def _tables(spark, sf_dir) -> dict:
    keys = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"]}
    return {name: (read(spark, sf_dir, name), k) for name, k in keys.items()}


_RANGE = "cast(l_linenumber as int) as r0, cast(l_partkey % 800 + 1 as int) as c0, cast(l_linenumber + l_suppkey % 3 as int) as r1, cast(l_partkey % 800 + 1 + l_orderkey % 2 as int) as c1"


@query(f"select {_RANGE} from lineitem")
def a1_ranges(spark, sf_dir):
    """Ranges written as A1 text, or as numbers, and read back."""
    r = read(spark, sf_dir, "lineitem").selectExpr(*_RANGE.split(", "))
    numbers = F.format_string("R%dC%d:R%dC%d", "r0", "c0", "r1", "c1")
    text = F.when(F.col("r0") % 2 == 0, T.a1_range(F.col("r0"), F.col("c0"), F.col("r1"), F.col("c1"))).otherwise(numbers)
    return r.select(T.boundaries(text).alias("x")).select("x.*")


_SECONDS = "o_orderkey * 37 % 200000 - 50000"


@query(f"""select o_orderkey, case when s < 0 then '-' else '' end || case when s = 0 then 'PT0S' else 'P' || case when abs(s) >= 86400 then (abs(s) // 86400) || 'D' else '' end || case when abs(s) % 86400 > 0 then 'T' else '' end
      || case when abs(s) % 86400 >= 3600 then (abs(s) % 86400 // 3600) || 'H' else '' end || case when abs(s) % 3600 >= 60 then (abs(s) % 3600 // 60) || 'M' else '' end || case when abs(s) % 60 > 0 then (abs(s) % 60) || 'S' else '' end end as duration
      from (select o_orderkey, {_SECONDS} as s from orders)""")
def iso_durations(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.iso_duration(F.expr(_SECONDS)).alias("duration"))


#: Columns of the dropped tables: table, place, name, whether numeric.
_DROPPED = "(values ('region', 1, 'r_regionkey', true), ('region', 2, 'r_name', false), ('nation', 1, 'n_nationkey', true), ('nation', 2, 'n_name', false), ('nation', 3, 'n_regionkey', true), ('supplier', 1, 's_suppkey', true), ('supplier', 2, 's_name', false), ('supplier', 3, 's_nationkey', true), ('supplier', 4, 's_acctbal', true), ('part', 1, 'p_partkey', true), ('part', 2, 'p_name', false), ('part', 3, 'p_brand', false), ('part', 4, 'p_type', false), ('part', 5, 'p_size', true), ('part', 6, 'p_retailprice', true)) as c(t, i, name, number)"
_CHOICE_COLUMNS = " union all ".join(f"select '{t}' as t from {t} having count({c}) >= 20 and count(distinct {c}) <= 20" for t, c in (("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type")))


@query(
    f"""with c as (select *, max(i) over (partition by t) as width from {_DROPPED}), choice as ({_CHOICE_COLUMNS}),
    tables as (select t, bool_or(not number and i <= 3 and i < width) as stub, bool_or(number and not list_has_any(string_split(name, '_'), ['id', 'code', 'key', 'name', 'type', 'number', 'count', 'index', 'year'])) as unitless, t in (select t from choice) as choice from c group by t),
    checks as (select t, 1 as level, 8 as n, [] as failed from tables union all select t, 2, 2 + stub::int + 2 * choice::int, [] from tables union all select t, 3, 5, case when unitless then ['L3-04'] else [] end from tables)
    select grain, t as file_id, case when grain <> 'file' then 0 end as sheet_ix, case when grain = 'table' then 0 end as region_ix, level, (100 - 10 * len(failed))::bigint as score, false as forced_zero, n::bigint as n_checks, len(failed)::bigint as n_failed, array_to_string(failed, ',') as failed_rules, '' as forced_rules
    from checks, (values ('table'), ('sheet'), ('file')) as g(grain)"""
)
def table_scores(spark, sf_dir):
    """The flagship: tables as sheets, all rules, and level scores."""
    x = context(spark, _tables(spark, sf_dir))
    _, checks = rules.evaluate(x, list(rules.REGISTRY))
    return scoring.scores(checks).withColumns({c: F.array_join(c, ",") for c in ("failed_rules", "forced_rules")})


QUERIES.update(rule_queries.QUERIES)
SQL.update(rule_queries.SQL)
