"""One query for each rule: its checks over sheets made from all orders, with equal SQL.

Five customers' orders are a sheet. Its place, headers, merges, formats and raw-text
diagnoses follow from the sheet's number, its texts from the order's, so that each
rule meets sheets that pass, fail and are skipped. The SQL derives the same checks
from the orders alone and shares only these making-of expressions with the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridscope.model import RULE, RULES
from gridscope.operators import rules

#: Texts of a body row by column, and headers by column; {s} is the engine's text type, k the sheet, ok the order.
ITEM = "case when ok % 6 = 0 then null when ok % 6 = 1 then '同上' else st end"
AMOUNT = "case when ok % 8 = 0 then cast(ok as {s}) || '円' when ok % 8 = 1 then cast(ok as {s}) || '%' when ok % 8 = 2 then cast(ok as {s}) || ' (x)' when ok % 8 = 3 then '▲' || cast(ok as {s}) when ok % 8 = 4 then '-' when ok % 8 = 5 then 'x1y' else cast(ok as {s}) end"
WHEN = "case when ok % 7 = 0 then {iso} when ok % 7 = 1 then {slash} when ok % 7 = 2 then 'H30.1.2' when ok % 7 = 3 then '令和3年' when ok % 7 = 4 then '03/04/01' when ok % 7 = 5 then {year} || '年度' else 'x' end"
PLACE = "case when ok % 5 = 0 then '東京' when ok % 5 = 1 then '東京都' when ok % 5 = 2 then '札幌' when ok % 5 = 3 then '札幌市' else 'x' end"
ANSWER = "case when ok % 41 = 0 then 'その他' || cast(ok % 3 as {s}) when ok % 43 = 0 then 'はい※1' when pri = '1-URGENT' then 'はい' else 'いいえ' end"
NOTE = "case when ok % 9 = 0 then ' a' when ok % 9 = 1 then 'a  b' when ok % 9 = 2 then 'あ　い' when ok % 9 = 3 then '1,2' when ok % 9 = 4 then 'a、b、c' when ok % 9 = 5 then '①' when ok % 9 = 6 then 'Ａ' when ok % 9 = 7 then 'Ⅲ' else 'ok' end"
_YEARS, _NUMBERED = "k % 11 = 2", "k % 13 = 1 and k % 11 <> 2"
HEADERS = [
    f"case when {_YEARS} then '2019' else '項目' end",
    f"case when {_YEARS} then '2020' when k % 10 = 4 then '' when k % 10 = 6 then '項目' else '金額' end",
    f"case when {_YEARS} then '2021' when {_NUMBERED} then 'q_1' else '年月' end",
    f"case when {_YEARS} then '2022' when {_NUMBERED} then 'q_2' else '都道府県' end",
    f"case when {_NUMBERED} then 'q_3' else '回答' end",
    f"case when {_NUMBERED} then 'q_4' else '備考' end",
    "case when k % 3 = 1 then '合計（円）' else '合計' end",
]
TYPES = ["text", "numeric", "date", "text", "text", "text", "numeric"]
_SPARK = {"s": "string", "iso": "date_format(d, 'yyyy-MM-dd')", "slash": "date_format(d, 'yyyy/M/d')", "year": "date_format(d, 'yyyy')"}
_DUCK = {"s": "varchar", "iso": "strftime(d, '%Y-%m-%d')", "slash": "strftime(d, '%Y/%-m/%-d')", "year": "strftime(d, '%Y')"}
#: A sheet's first row, header rows and blank rows behind them; then its last header row, first and last body row.
_PLACES = {"top": "case when k % 5 = 1 then 3 else 1 end", "heads": "case when k % 9 = 8 then 0 when k % 7 = 3 then 3 else 1 end", "gap": "case when k % 8 = 5 and k % 9 <> 8 then 1 else 0 end"}
_ENDS = {"head": "top + heads - 1", "body": "top + heads + gap", "bottom": "top + heads + gap + n - 1"}
FORMAT = "case when k % 17 = 0 then 'pdf' when k % 2 = 0 then 'xlsx' else 'csv' end"


def sheets(spark: SparkSession, sf_dir: str) -> rules.Context:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey div 5 as k", "o_orderkey as ok", "o_totalprice as price", "o_orderpriority as pri", "o_orderstatus as st", "o_orderdate as d")
    o = o.selectExpr("*", "cast(row_number() over (partition by k order by ok) as int) as rn")
    s = o.groupBy("k").agg(F.count("*").cast("int").alias("n")).selectExpr("*", *[f"cast({v} as int) as {c}" for c, v in _PLACES.items()]).selectExpr("*", *[f"{v} as {c}" for c, v in _ENDS.items()])
    s = s.withColumns({"file_id": F.expr("'c' || cast(k as string)"), "sheet_ix": F.lit(0), "format": F.expr(FORMAT)})
    null = lambda t: F.lit(None).cast(t)
    texts = [F.expr(x.format(**_SPARK)) for x in (ITEM, AMOUNT, WHEN, PLACE, ANSWER, NOTE)]
    cell = lambda col, kind, text, number, *marks: F.struct(F.lit(col).alias("col"), F.lit(kind).alias("vtype"), text.alias("vtext"), number.alias("vnum"), *[m.alias(c) for m, c in zip(marks, ("font", "bg", "bold", "italic", "m_row", "m_col"))])
    plain = [null("string"), null("string"), F.lit(False), F.lit(False), null("int"), null("int")]
    marked = [F.expr("case when ok % 10 = 3 then 'FFFF0000' end"), F.expr("case when ok % 10 = 5 then 'FFFFFF00' end"), F.expr("ok % 10 = 7"), F.expr("ok % 10 = 9"), null("int"), null("int")]
    body = [cell(i, "str", t, null("double"), *plain) for i, t in enumerate(texts, 1)] + [cell(7, "num", F.col("price").cast("string"), F.col("price"), *marked)]
    body = o.join(s.select("k", "file_id", "sheet_ix", "body"), "k").select("file_id", "sheet_ix", (F.col("body") + F.col("rn") - 1).alias("row"), F.explode(F.array(*body)).alias("x"))
    slave = F.expr("k % 5 = 2 and row = head")
    heads = [cell(i, "str", F.expr(h), null("double"), *(plain if i != 3 else [*plain[:4], F.when(slave, F.col("head")), F.when(slave, 2)])) for i, h in enumerate(HEADERS, 1)]
    heads = s.where("heads > 0").select("k", "file_id", "sheet_ix", "head", F.explode(F.sequence("top", "head")).alias("row")).select("file_id", "sheet_ix", "row", F.explode(F.array(*heads)).alias("x"))
    cells = body.unionByName(heads).select("file_id", "sheet_ix", "row", "x.*").where("vtext <> ''").withColumns({"formula": null("string"), "merged": F.col("m_row").isNotNull()})
    ints = lambda *x: F.array(*x).cast("array<int>")
    names, types = F.map_from_arrays(ints(*map(F.lit, range(1, 8))), F.array(*map(F.expr, HEADERS))), F.map_from_arrays(ints(*map(F.lit, range(1, 8))), F.array(*map(F.lit, TYPES)))
    no_map = F.expr("map_from_arrays(cast(array() as array<int>), cast(array() as array<string>))")
    region = ["file_id", "sheet_ix"]
    main = s.select(*region, F.lit(0).alias("region_ix"), F.col("top").alias("start_row"), F.lit(1).alias("start_col"), F.col("bottom").alias("end_row"), F.lit(7).alias("end_col"), F.when(F.col("heads") > 0, F.sequence("top", "head")).otherwise(ints()).alias("header_rows"), F.col("body").alias("body_start"), F.col("bottom").alias("body_end"), F.when(F.col("heads") > 0, names).otherwise(no_map).alias("headers"), types.alias("types"), F.when(F.expr("k % 3 <> 0"), ints(F.lit(1))).otherwise(ints()).alias("stub_cols"), F.lit(0.95).alias("confidence"))
    second = s.where("k % 6 = 1").select(*region, F.lit(1).alias("region_ix"), (F.col("bottom") + 3).alias("start_row"), F.lit(1).alias("start_col"), (F.col("bottom") + 4).alias("end_row"), F.lit(2).alias("end_col"), ints().alias("header_rows"), (F.col("bottom") + 3).alias("body_start"), (F.col("bottom") + 4).alias("body_end"), no_map.alias("headers"), no_map.alias("types"), ints().alias("stub_cols"), F.expr("case when k % 4 = 1 then 0.4D else 0.9D end").alias("confidence"))
    regions = main.unionByName(second).withColumns({"merged_headers": ints(), "abstain": F.lit(False)})
    loaded = F.expr("k % 10 <> 0")
    hidden_rows, hidden_cols = F.when(F.expr("k % 4 = 1 or k % 4 = 2"), ints(F.col("body") + 1, F.col("body") + 2, F.col("body") + 5)).otherwise(ints()), F.when(F.expr("k % 4 = 2"), ints(F.lit(3))).otherwise(ints())
    of_sheets = s.select(*region, F.col("file_id").alias("sheet"), F.col("file_id").alias("name"), "format", F.expr("case when k % 4 = 1 then 'cp932' else 'utf-8' end").alias("encoding"), F.col("bottom").alias("max_row"), F.lit(7).alias("max_col"), F.lit(False).alias("hidden"), hidden_rows.alias("hidden_rows"), hidden_cols.alias("hidden_cols"), loaded.alias("formulas_loaded"), loaded.alias("objects_loaded"))
    merges = s.where("k % 5 = 2 and heads > 0").select(*region, F.col("head").alias("start_row"), F.lit(2).alias("start_col"), F.col("head").alias("end_row"), F.lit(3).alias("end_col")).unionByName(s.where("k % 5 = 3").select(*region, F.col("body").alias("start_row"), F.lit(1).alias("start_col"), (F.col("body") + 1).alias("end_row"), F.lit(1).alias("end_col")))
    reference = lambda where, kind, row, col: s.where(where).select(*region, F.lit(kind).alias("kind"), F.expr(row).alias("row"), F.lit(col).alias("col"), F.lit("x").alias("detail"))
    references = reference("k % 6 = 2", "object", "body", 2).unionByName(reference("k % 6 in (0, 4)", "formula", "body + 1", 7)).unionByName(reference("k % 6 = 4", "error_ref", "body + 1", 7))
    sample = lambda kind, severity, row: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.expr(row).alias("row"), F.lit(1).alias("line"), F.lit("").alias("preview"))
    counts = F.map_from_arrays(F.array(F.lit("multiline_record"), F.lit("unquoted_quote")), F.expr("array(k % 4, case when k % 5 = 0 then 2L else 0L end)"))
    samples = F.array_compact(F.array(F.when(F.expr("k % 4 > 0"), sample("multiline_record", "error", "body")), F.when(F.expr("k % 5 = 0"), sample("field_count_mismatch", "warning", "body + 1"))))
    diagnoses = s.where("k % 3 <> 0").select(*region, F.col("n").cast("long").alias("records"), counts.alias("counts"), samples.alias("samples"), F.lit(0.9).alias("confidence"))
    others = s.where("k % 5 = 1").select(*region, F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("t").alias("text"), F.lit("title").alias("kind"))
    return rules.Context(cells, of_sheets, merges, references, diagnoses, regions, others)


def checks_of(context: rules.Context, rule_id: str) -> DataFrame:
    """A rule's check of each table, its violations by severity, and sums over their places."""
    found, checks = rules.evaluate(context, [rule_id], strict=True)
    place = F.col("start_row") * 31 + F.col("start_col") * 7 + F.col("end_row") * 3 + F.col("end_col")
    by = ["file_id", "sheet_ix", "region_ix"]
    kinds = {f"n_{s}": F.count_if(F.col("severity") == s) for s in ("error", "warning", "info")}
    found = found.groupBy(*by).agg(*[v.alias(c) for c, v in kinds.items()], F.min("start_row").alias("first_row"), F.max("end_row").alias("last_row"), F.sum(place).alias("places"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return checks.join(found, by, "left").select("file_id", "region_ix", "passed", F.col("severity"), F.round("confidence", 3).alias("confidence"), zero("n_violations"), *map(zero, kinds), zero("first_row"), zero("last_row"), zero("places"))


def _union(parts: list[str]) -> str:
    return " union all ".join(parts)


_BODY = _union([f"select k, body + rn - 1 as row, {i} as col, 'str' as vtype, {x.format(**_DUCK)} as t, ok, body from rows" for i, x in enumerate((ITEM, AMOUNT, WHEN, PLACE, ANSWER, NOTE), 1)] + ["select k, body + rn - 1, 7, 'num', cast(price as varchar), ok, body from rows"])
_HEADS = _union([f"select k, top, head, {i} as col, {h} as t from s where heads > 0" for i, h in enumerate(HEADERS, 1)])
_BASE = f"""o as (select o_custkey // 5 as k, o_orderkey as ok, o_totalprice as price, o_orderpriority as pri, o_orderstatus as st, o_orderdate as d, cast(row_number() over (partition by o_custkey // 5 order by o_orderkey) as int) as rn from orders),
s as (select *, {', '.join(f'{v} as {c}' for c, v in _ENDS.items())} from (select *, {', '.join(f'{v} as {c}' for c, v in _PLACES.items())} from (select k, cast(count(*) as int) as n from o group by k))),
rows as (select o.*, s.body from o join s using (k)),
body as (select * from ({_BODY}) where t is not null),
heads as ({_HEADS}),
header_cells as (select k, unnest(range(top, head + 1)) as row, col, 'str' as vtype, t, top, head from heads where t <> ''),
cells as (select k, row, col, vtype, t from body union all select k, row, col, vtype, t from header_cells),
r as (select k, 0 as ix, top as r0, 1 as c0, bottom as r1, 7 as c1, heads, head, body, 0.95 as sure from s union all select k, 1, bottom + 3, 1, bottom + 4, 2, 0, null, bottom + 3, case when k % 4 = 1 then 0.4 else 0.9 end from s where k % 6 = 1)"""


def _sql(rule_id: str, found: str | None, states: str | None = None) -> str:
    """found: k, ix, a, b, c, d, sev of violations; states: k, ix, passed, sure, sev where a verdict is not simply "none found"."""
    rule = RULE[rule_id]
    target = {"common": "true", "excel": f"({FORMAT}) = 'xlsx'", "csv": f"({FORMAT}) <> 'xlsx'"}[rule.target]
    fail = rule.confidence_fail if rule.confidence_fail is not None else rule.confidence
    none = "select 0 as k, 0 as ix, 0 as a, 0 as b, 0 as c, 0 as d, '' as sev from r where false"
    return f"""with {_BASE}, v as ({found or none}), st as ({states or "select 0 as k, 0 as ix, true as passed, 0.0 as sure, '' as sev from r where false"}),
n as (select k, ix, count(*) as n, count(*) filter (where sev = 'error') as e, count(*) filter (where sev = 'warning') as w, count(*) filter (where sev = 'info') as i, min(a) as first_row, max(c) as last_row, sum(a * 31 + b * 7 + c * 3 + d) as places from v group by k, ix),
x as (select 'c' || r.k as file_id, r.ix as region_ix, coalesce(st.passed, n.n is null) as passed, coalesce(st.sev, '{rule.severity}') as severity, st.sure, n.* exclude (k, ix) from r left join n using (k, ix) left join st using (k, ix) where {target.replace('k %', 'r.k %')})
select file_id, region_ix, passed, severity, cast(round(coalesce(sure, case when passed then {rule.confidence} else {fail} end), 3) as double) as confidence, coalesce(n, 0) as n_violations, coalesce(e, 0) as n_error, coalesce(w, 0) as n_warning, coalesce(i, 0) as n_info,
cast(coalesce(first_row, 0) as bigint) as first_row, cast(coalesce(last_row, 0) as bigint) as last_row, cast(coalesce(places, 0) as bigint) as places from x"""


def _cell(sev: str, source: str, where: str = "true") -> str:
    """One violation for each cell of the first table."""
    return f"select k, 0 as ix, row as a, col as b, row as c, col as d, {sev} as sev from {source} where {where}"


_HEADLESS = "select k, ix, true as passed, {sure} as sure, null as sev from r where heads = 0"
_SKIPPED = "select k, ix, true as passed, 0.0 as sure, null as sev from r"
_LOADED = "select k, ix, true as passed, 0.0 as sure, null as sev from r where k % 10 = 0"
_VALUES = "select k, col, v, count(*) as n, min(row) as row, sum(count(*)) over (partition by k, col) as rows, count(*) over (partition by k, col) as kinds from (select k, row, col, trim(t, ' 　') as v from body where col in (1, 4, 5, 6)) group by k, col, v"
_CHOICES = f"select *, n <= 2 and n / rows <= 0.05 as rare from ({_VALUES}) where rows >= 20 and kinds <= 20"
_NO_CHOICE = f"select k, ix, true as passed, 0.0 as sure, null as sev from r where (k, ix) not in (select k, 0 from ({_CHOICES}))"
_ALIKE = "(u.v = a.v || '都' or a.v = u.v || '都' or u.v = a.v || '市' or a.v = u.v || '市' or a.v = u.v || '※1' or u.v = a.v || '※1' or (starts_with(a.v, 'その他') and starts_with(u.v, 'その他')))"
_TIMES = "select k, row, ok, case when ok % 7 = 0 then 'iso_date' when ok % 7 = 1 then 'slash' when ok % 7 = 2 then 'jis_era' when ok % 7 = 3 then 'era' when ok % 7 = 4 then 'vague' when ok % 7 = 5 then 'fiscal_year' end as form from body where col = 3 and k in (select k from heads where col = 3 and t = '年月')"
_SHARE = r"select k, col from body where row < body + 30 group by k, col having count(*) filter (where vtype = 'num' or regexp_matches(t, '^[\s\-ー−▲△]*[\d,]+\.?\d*\s*$')) >= 0.7 * count(*)"
_KNOWN = "select k from body where col = 4 and row < body + 30 group by k having count(*) filter (where ok % 5 <> 4) >= 0.5 * count(*)"
_REGIONS = f"select k from heads where col = 4 and (t = '都道府県' or k in ({_KNOWN}))"
_CSV = "select r.k, r.ix, {failed} is null or not {failed} as passed, case when r.k % 3 = 0 then 0.0 else 0.9 end as sure, null as sev from r"

_FOUND: dict[str, tuple[str | None, str | None]] = {
    "L1-01": ("select k, ix, r0 as a, c0 as b, r0 as c, c0 as d, 'error' as sev from r where k % 17 = 0", None),
    "L1-02": ("select k, 0 as ix, r0 as a, c0 as b, r1 as c, c1 as d, 'warning' as sev from r where k % 6 = 1 and k % 4 <> 1", None),
    "L1-03": (
        _union([
            "select k, 0 as ix, head + 1 as a, 1 as b, head + 1 as c, 7 as d, 'error' as sev from s where gap = 1",
            "select s.k, 0, top, c.col, bottom, c.col, 'error' from s, (select unnest(range(1, 8)) as col) c where bottom - top + 1 > 2 and (s.k, c.col) not in (select k, col from cells)",
            "select s.k, 0, bottom + u.i, 1, bottom + u.i, 7, 'error' from s, (values (1), (2)) u(i) where k % 6 = 1",
        ]), None),
    "L1-04": ("select k, ix, 1 as a, 1 as b, 1 as c, 1 as d, 'warning' as sev from r where k % 5 = 1", None),
    "L1-05": (
        _union([
            "select k, 0 as ix, top as a, 2 as b, top as c, 2 as d, 'error' as sev from heads where col = 2 and t = ''",
            "select s.k, 0, top, 1, top, 1, 'error' from s where heads = 0 and (s.k, top, 1) not in (select k, row, col from body) and (s.k, 1) in (select k, col from body)",
        ]), None),
    "L1-06": (_cell("'warning'", "body", "col = 6 and ok % 9 in (0, 1, 2)"), None),
    "L1-07": (_cell("'warning'", "body", "col = 6 and ok % 9 in (3, 4)"), None),
    "L1-08": (_cell("case when ok % 9 = 6 then 'info' else 'warning' end", "body", "col = 6 and ok % 9 in (5, 6, 7)"), "select k, ix, not (k % 4 = 1 and ix = 0 and k in (select k from body where col = 6 and ok % 9 in (5, 7))) as passed, null as sure, null as sev from r"),
    "L1-09": (None, "select k, ix, null as passed, 0.0 as sure, null as sev from r"),
    "L1-10": ("select k, 0 as ix, body as a, 2 as b, body as c, 2 as d, 'error' as sev from s where k % 6 = 2", _LOADED),
    "L1-11": (
        _union([f"select k, 0 as ix, min(row) as a, 7 as b, max(row) as c, 7 as d, '{sev}' as sev from body where col = 7 group by k having count(*) >= 2 and count(*) filter (where ok % 10 = {m}) between 1 and count(*) - 1" for m, sev in ((3, "warning"), (5, "warning"), (7, "info"), (9, "info"))]), None),
    "L1-12": (
        "select k, 0 as ix, head as a, 2 as b, head as c, 3 as d, 'info' as sev from s where k % 5 = 2 and heads > 0 union all select k, 0, body, 1, body + 1, 1, 'error' from s where k % 5 = 3",
        "select k, ix, k % 5 = 2 as passed, null as sure, case when k % 5 = 2 then 'major' else 'fatal' end as sev from r where ix = 0 and (k % 5 = 3 or k % 5 = 2 and heads > 0)"),
    "L1-13": (
        _union([
            "select r.k, ix, s.body + 1 as a, 1 as b, least(s.body + 2, bottom) as c, 7 as d, 'error' as sev from r join s using (k) where r.k % 4 in (1, 2) and s.body + 1 <= bottom",
            "select r.k, ix, s.body + 5, 1, s.body + 5, 7, 'error' from r join s using (k) where r.k % 4 in (1, 2) and s.body + 5 <= bottom",
            "select r.k, ix, 1, 3, bottom, 3, 'error' from r join s using (k) where r.k % 4 = 2",
        ]), None),
    "L1-14": ("select k, 0 as ix, body as a, 1 as b, body as c, 7 as d, 'error' as sev from s where k % 3 <> 0 and k % 4 > 0", _CSV.format(failed="(r.k % 3 <> 0 and r.k % 4 > 0)")),
    "L1-15": ("select k, 0 as ix, body + 1 as a, 1 as b, body + 1 as c, 7 as d, 'warning' as sev from s where k % 3 <> 0 and k % 5 = 0 and body + 1 <= bottom", _CSV.format(failed="(r.k % 3 <> 0 and r.k % 5 = 0)")),
    "L2-01": (_cell("case when ok % 8 = 2 then 'warning' else 'error' end", "body", "col = 2 and ok % 8 in (0, 1, 2, 3, 5)"), None),
    "L2-02": (
        "select k, 0 as ix, row as a, 1 as b, row as c, 1 as d, case when v = 1 then 'error' else 'warning' end as sev from (select k, body + rn - 1 as row, ok % 6 as v, max(case when ok % 6 > 1 then 1 else 0 end) over (partition by k order by rn rows between unbounded preceding and 1 preceding) as seen from rows where k % 3 <> 0) where v = 1 or v = 0 and seen = 1",
        "select k, ix, true as passed, 0.0 as sure, null as sev from r where ix = 1 or k % 3 = 0"),
    "L2-03": (
        _union([
            "select k, 0 as ix, head as a, 2 as b, head as c, 3 as d, 'error' as sev from s where k % 5 = 2 and heads > 0",
            "select k, 0, top, 2, top, 2, 'error' from heads where col = 2 and t = ''",
            "select k, 0, top, col, top, col, 'error' from heads where col < 3 and (k, '項目', '項目') in (select x.k, x.t, y.t from heads x join heads y using (k) where x.col = 1 and y.col = 2)",
        ]), _HEADLESS.format(sure=0.4)),
    "L2-04": (f"with u as ({_CHOICES}) select distinct a.k, 0 as ix, a.row as a, a.col as b, a.row as c, a.col as d, 'warning' as sev from u a join u on u.k = a.k and u.col = a.col and a.rare and not u.rare and {_ALIKE}", _NO_CHOICE),
    "L2-05": (f"select k, 0 as ix, row as a, col as b, row as c, col as d, 'warning' as sev from (select *, count(*) over (partition by k, col) as forms from ({_CHOICES}) where contains(v, 'その他')) where forms >= 2 and n < 3", _NO_CHOICE),
    "L2-06": ("select k, 0 as ix, body + 1 as a, 7 as b, body + 1 as c, 7 as d, 'error' as sev from s where k % 6 in (0, 4) and body + 1 <= bottom", _LOADED),
    "L3-01": (
        _union([
            "select k, ix, r0 as a, c0 as b, r0 as c, c1 as d, 'error' as sev from r where r0 > 1",
            "select k, 0, head + 1, 1, body - 1, 7, 'error' from s where gap = 1",
            "select k, 0, top, 1, head, 7, 'info' from s where heads = 3",
        ]), "select k, ix, null as passed, null as sure, case when r0 > 1 or ix = 0 and k % 8 = 5 and k % 9 <> 8 then 'fatal' else 'major' end as sev from r"),
    "L3-04": (f"select k, 0 as ix, head as a, col as b, head as c, col as d, 'warning' as sev from heads where t in ('項目', '年月', '都道府県', '回答', '備考', '合計') and (k, col) in ({_SHARE})", _HEADLESS.format(sure=0.5)),
    "L3-05": (
        f"""with times as ({_TIMES}) select k, 0 as ix, row as a, 3 as b, row as c, 3 as d, case when form = 'era' then 'error' else 'warning' end as sev from times where form in ('era', 'vague')
        union all select k, 0, head, 3, head, 3, 'warning' from s where k in (select k from times where form not in ('era', 'vague') group by k having count(distinct form) > 1)""", _HEADLESS.format(sure=0.5)),
    "L3-06": (
        f"""select k, 0 as ix, row as a, 4 as b, row as c, 4 as d, 'warning' as sev from body where col = 4 and ok % 5 in (0, 2) and k in ({_REGIONS})
        union all select k, 0, min(row), 4, min(row), 4, 'info' from body where col = 4 and ok % 5 in (1, 3) and k in ({_REGIONS}) group by k""",
        _HEADLESS.format(sure=0.5) + f" union all select k, ix, true, 0.6, null from r where heads > 0 and k not in ({_REGIONS})"),
    "L3-09": (
        f"select k, 0 as ix, head as a, 1 as b, head as c, 4 as d, 'warning' as sev from s where heads > 0 and {_YEARS} union all select k, 0, head, 3, head, 6, 'info' from s where heads > 0 and {_NUMBERED}", _HEADLESS.format(sure=0.5)),
    **{i: (None, _SKIPPED) for i in ("L3-02", "L3-03", "L3-07", "L3-08")},
}


def _query(rule_id: str):
    return lambda spark, sf_dir: checks_of(sheets(spark, sf_dir), rule_id)


QUERIES = {f"rule_{r.rule_id.replace('-', '_')}": _query(r.rule_id) for r in RULES}
SQL = {f"rule_{i.replace('-', '_')}": _sql(i, *found) for i, found in _FOUND.items()}
