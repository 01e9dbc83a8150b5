"""Queries that parse notices and pages, written out of the columns of whole driver tables: SQL then says what must be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import html, notices, products, text
from sievegrid.operators import sites
from sievegrid.plans.tables import _table


#: Rows that one task parses at most.
TASK_ROWS = 20_000


def _rows(spark: SparkSession, sf_dir: str, name: str, most: int = TASK_ROWS) -> DataFrame:
    """A table whose rows are dear to parse, dealt into tasks of so many rows, one for each core at least: files may hold any number of them."""
    df = _table(spark, sf_dir, name)
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-df.count() // most)))


def _day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy年M月d日")


def notice_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tenders; every seventh has no number, every fifth no time for its bids."""
    o = _rows(spark, sf_dir, "orders")
    k, at = F.col("o_orderkey"), F.add_months("o_orderdate", 240)  # notices are of this century
    day = lambda n: _day(F.date_add(at, n))
    said = F.concat(
        F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("项目编号：ORD-"), k, F.when(k % 3 == 0, ")公开招标公告").otherwise(""), F.lit("\n"))),
        F.lit("项目名称：床 "), k, F.lit(" 采购项目  预算金额："), F.format_string("%d.%d", (k % 1000).cast("int"), (k % 10).cast("int")), F.lit("万元 采购人信息 名称：客户 "), F.col("o_custkey"),
        F.lit(" 地址：路 1 号 行政区域：天津 公告时间："), _day(at), F.lit(" 三、获取招标文件 时间："), day(1), F.lit("至"), day(5), F.lit("，每天上午 9:00 至 11:30，下午 13:00 至 "), (k % 4 + 14).cast("string"),
        F.lit(":30 地点：线上 提交投标文件截止时间："), F.when(k % 5 == 0, "另行通知").otherwise(F.concat(day(20), F.lit(" "), F.when(k % 11 == 0, "24:00").otherwise("9点30分"))),
        F.lit(" 项目联系人：Contact A 联系电话："), F.when(k % 2 == 0, "022-1234567").otherwise("12-3"),
    )
    f = o.select("o_orderkey", notices.tender_facts(said).alias("f"))
    return f.select("o_orderkey", *[F.col(f"f.{c}") for c in ("project_number", "project_name", "buyer_name", "region", "published_at", "registration_deadline", "bid_deadline", "budget_cny", "error_code")], F.col("f.public_contact.phone").alias("phone"))


def notice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as corrections and terminations: with an exact new time, without one, with other terms changed, and with nothing tracked."""
    o = _rows(spark, sf_dir, "orders")
    k, at = F.col("o_orderkey"), F.add_months("o_orderdate", 240)  # notices are of this century
    exact = F.concat(F.lit("原公告的投标文件提交截止时间：2020-01-02 09:30:00，更正为："), F.date_format(F.date_add(at, 9), "yyyy-M-d"), F.lit(" 14:05:00。"))
    change = F.when(k % 5 == 0, F.lit("联系人有误")).when(k % 3 == 0, exact).when(k % 3 == 1, "投标截止时间另行变更").otherwise(F.concat(exact, F.lit("技术参数有变")))
    said = F.when(k % 4 == 0, F.concat(F.lit("终止公告 项目编号：T-"), k, F.lit(" 发布日期："), _day(at))).otherwise(F.concat(F.lit("更正公告 采购需求 项目编号：T-"), k, F.lit(" 二、更正信息 更正内容："), change, F.lit(" 更正日期："), F.date_format(at, "yyyy-MM-dd"), F.lit(" 三、其他补充事宜 无")))
    e = o.select("o_orderkey", notices.event_facts(said).alias("e"))
    return e.select("o_orderkey", "e.event_type", "e.project_number", "e.published_at", F.array_join("e.changed_fact_paths", ",").alias("changed"), F.try_element_at("e.fact_overrides", F.lit("facts.bid_deadline")).alias("bid_deadline"), F.array_join("e.unresolved_fact_paths", ",").alias("unresolved"), "e.requires_reconciliation", "e.terminal")


def notice_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products of notices in seven layouts."""
    p = _rows(spark, sf_dir, "part")
    k, size, name = F.col("p_partkey"), F.col("p_size").cast("string"), F.concat(F.regexp_replace("p_name", " ", ""), F.lit("分析仪"))
    layouts = [
        F.concat(F.lit("采购需求：主要标的名称："), name, F.lit("；数量："), size, F.lit("台；合同履行期限：x")),
        F.concat(F.lit("采购需求：简要规格描述或项目基本概况介绍、用途："), name, size, F.lit("套。 备注：无")),
        F.concat(F.lit("采购需求：包1:"), name, F.lit("、数量："), size, F.lit("台。")),
        F.concat(F.lit("采购需求\n品目号\n品目名称\n数量\n计量单位\n1\n"), name, F.lit("\n"), size, F.lit("\n台\n合同履行期限")),
        F.concat(F.lit("采购需求\n序号\n产品名称\n数量\n1\n"), name, F.lit("\n"), size, F.lit("台\n合同履行期限")),
        F.concat(F.lit("采购需求 1、"), name, F.lit(" "), size, F.lit("台：参数")),
        F.concat(F.lit("第一包："), name, F.lit("的采购；")),
    ]
    said = F.get(F.array(*layouts), (k % len(layouts)).cast("int"))
    found = products.cascade(products.text_products(said), products.package_products(said))
    return p.select("p_partkey", F.posexplode(found).alias("place", "i")).select("p_partkey", "place", "i.raw_name", "i.quantity")


def table_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages with a table of two layouts, of which every fifth row has no fit amount."""
    p = _rows(spark, sf_dir, "part")
    k = F.col("p_partkey")
    amount = F.when(k % 5 == 0, "约2台").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("台")))
    standard = F.concat(F.lit("<table><tr><th>品目名称</th><th>采购标的</th><th>数量（单位）</th></tr><tr><td>"), "p_type", F.lit("</td><td>"), "p_name", F.lit("</td><td>"), amount, F.lit("</td></tr></table>"))
    general = F.concat(F.lit("<table><tr><th rowspan=2>货物名称</th><th colspan=2>数量</th></tr><tr><td>a</td><td>b</td></tr><tr><td>"), "p_name", F.lit("</td><td>"), amount, F.lit("</td><td>x</td></tr><tr><td>备注</td><td>1台</td><td></td></tr><tr><td>no</td><td>1台</td><td></td></tr></table>"))
    pages = p.select("p_partkey", F.when(k % 2 == 0, standard).otherwise(general).alias("page")).select("p_partkey", html.tables("page").alias("tables"))
    return pages.select("p_partkey", F.explode(products.table_products(F.col("tables"))).alias("i")).select("p_partkey", "i.raw_name", "i.category", "i.quantity")


def search_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rows of a result list, with the metadata beside their links."""
    s = _table(spark, sf_dir, "supplier")
    row = F.concat(F.lit("<li><a href='/n/"), "s_suppkey", F.lit("'>"), "s_name", F.lit("</a> 2024.01.0"), (F.col("s_suppkey") % 9 + 1).cast("string"), F.lit(" 10:00 | 采购人：甲"), "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, " | 公开招标 | 北京市海淀区").when(F.col("s_suppkey") % 3 == 1, " | 公开招标公告 | 天津").otherwise(" | 招标 | 上海"), F.lit("</li>"))
    page = F.concat(F.lit('<div><ul class="vT-srch-result-list-bid">'), row, F.lit("<li>none</li></ul></div>"))
    rows = s.select("s_suppkey", html.list_rows(page).alias("rows")).select("s_suppkey", F.explode("rows").alias("r"))
    meta = notices.search_metadata(F.col("r.meta"))
    return rows.select("s_suppkey", "r.title", text.official_url(F.col("r.href"), F.lit("https://h.example/s/"), ["h.example"]).alias("url"), meta.alias("m")).select("s_suppkey", "title", "url", "m.*")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next pages of pages that get one by their number, and the length of what they say."""
    p = _table(spark, sf_dir, "pages")
    k = F.col("page_id")
    link = F.when(k % 3 == 0, F.concat(F.lit('<link rel="next" href="/p/'), k, F.lit('">'))).when(k % 3 == 1, F.concat(F.lit('<a class=x href="?page='), k, F.lit('"> 下一页 </a>'))).otherwise('<a href="https://other.example/">next</a>')
    nav = F.concat(F.lit("<nav>"), link, F.lit("</nav>"))
    return p.select("page_id", html.next_page(nav, F.lit("https://h.example/list?x=1"), ["h.example"]).alias("next_url"), F.length(html.regex_text(nav)).alias("n_chars"))


def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored in one of two charsets, read back."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("<meta charset=utf-8>医疗设备"), "html").alias("h"))
    stored = p.select("page_id", F.encode("h", "UTF-8").alias("b"), F.sha2("h", 256).alias("want"))
    return stored.select("page_id", F.sha2(html.decode_best("b", marks={"医疗设备": 30}), 256).alias("text_sha256"))


def site_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as articles of eight sites, each in its layout; every ninth with a date or a title other than its index's."""
    p = _rows(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.concat(F.lit("监护仪"), k)
    shift = (k % 27).cast("int")
    day = F.date_add(F.lit("2026-01-01").cast("date"), shift)
    shown = F.date_format(day, "yyyy-MM-dd")
    until = _day(F.date_add(day, 9))
    layouts = {
        "teda": (F.concat(name, F.lit("需求调研")), [name, F.lit("需求调研 医疗设备采购需求调研 一、拟采购设备项目：1、设备明细：1）"), name, F.lit("（彩色）"), size, F.lit("台 预算："), size, F.lit(".5万元 2、其他需求：无 二、报名资料 报名截止时间："), until, F.lit("下午3:05 甲老师：022-1234567 天津市泰达医院"), _day(day)]),
        "tjmugh": (F.lit("医疗设备市场调研"), [F.lit("天津医科大学总医院"), name, F.lit("市场调研论证邀请函 "), shown, F.lit(" 一、论证项目名称：（1）"), name, F.lit("；（2）泵 二、供应商 报名截止时间："), until, F.lit(" 9:30 联系电话：0221234567")]),
        "tjnothop": (F.concat(F.lit("天津市天津医院"), name, F.lit("采购项目调研公告")), [F.lit("天津市天津医院"), name, F.lit("采购项目调研公告 1、产品名称："), name, F.lit(" 2、采购数量："), size, F.lit("台 3、预算金额："), size, F.lit("万元 四、报名及资质提交时间："), _day(day), F.lit("至"), until, F.lit(" 五、论证时间 联系电话：022-1234567")]),
        "tjfch": (F.concat(name, F.lit("院内...")), [F.lit("<h1>"), name, F.lit("院内比选公告</h1> "), shown, F.lit(" 项目编号：N-"), k.cast("string"), F.lit(" 预算金额："), size, F.lit(",000元 响应文件递交截止时间："), until, F.lit("上午9:30 电话：022-1234567")]),
        "tjfch_test": (F.concat(name, F.lit("测试企业征集公告")), [F.lit("2001-01-01 "), name, F.lit("测试企业征集公告 "), shown, F.lit(" 自公告发布之日起7天，逾期无效 电话：022-1234567")]),
        "tjzxfc": (F.concat(F.lit("天津市中心妇产科医院"), name, F.lit("采购项目市场调研")), [F.lit("天津市中心妇产科医院"), name, F.lit("采购项目市场调研 时间："), shown, F.lit("<table><tr><td>1</td><td>泵</td></tr></table>提交时间截止"), until, F.lit(" 设备科电话：022-12345678")]),
        "tjzyefy": (F.concat(F.lit("关于"), name, F.lit("的调研公告")), [F.lit("天津中医药大学第二附属医院 关于"), name, F.lit("的调研公告 "), shown, F.lit(" 我院拟对"), name, F.lit("、泵等医疗设备采购项目进行院内调研 报名时间："), until, F.lit(" 16:00 联系电话：022-12345678")]),
        "tjzyefy_intent": (F.concat(F.lit("采购意向公告-"), name, F.lit("采购项目")), [F.lit("天津中医药大学第二附属医院 采购意向公告-"), name, F.lit("采购项目 "), shown, F.lit(" 欢迎供应商咨询 预计采购时间为2026年 "), (k % 9 + 1).cast("string"), F.lit(" 月 联系电话：022-12345678")]),
    }
    pick = lambda by: F.get(F.array(*by), (k % len(layouts)).cast("int"))
    host = pick([F.lit(sites.SITES[s].hosts[1]) for s in layouts])
    path = F.when(k % 8 == 0, F.concat(F.lit("/article/show/9/"), k)).otherwise(F.concat(F.lit("/system/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/"), k, F.lit(".shtml")))
    told = F.date_format(F.date_add(day, F.when(k % 9 == 0, 1).otherwise(0)), "yyyy-MM-dd")
    title = F.concat(F.when((k % 9 == 1) & (k % 8 != 1), "别").otherwise(""), pick([t for t, _ in layouts.values()]))
    pages = p.select("p_partkey", pick([F.lit(s) for s in layouts]).alias("site"), F.concat(F.lit("https://"), host, path).alias("url"), F.concat(F.lit("https://"), host, F.lit("/")).alias("index_url"), told.alias("published_at"), title.alias("title"), pick([F.concat(*parts) for _, parts in layouts.values()]).alias("html"))
    r = sites.site_records(pages)
    f = lambda n: F.col(f"facts.{n}")
    item = F.get(f("product_items"), F.lit(0))
    return r.select(
        "p_partkey", "opportunity_id", "error_code", f("published_at").alias("published_at"), F.coalesce(f("bid_deadline"), f("registration_deadline"), f("registration_deadline_date")).alias("until"), f("budget_cny").alias("budget_cny"), F.when(f("project_name").isNotNull(), F.size(f("product_items"))).alias("n_items"),
        item["raw_name"].alias("raw_name"), item["quantity"].alias("quantity"), item["specification"].alias("specification"), f("public_contact.phone").alias("phone"), F.array_join("quality_flags", ",").alias("flags"), F.size("evidence").alias("n_proofs"),
    )


def site_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as index pages of four sites with three links each, of which one repeats or says something else."""
    s = _table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    kinds = [("teda", "设备需求调研", "设备需求调研结果"), ("tjnothop", "天津市天津医院床采购项目调研公告", "招聘公告"), ("tjfch", "床院内比选公告", "床院内比选结果公告"), ("tjzyefy_intent", "床采购意向公告", "床采购公告")]
    pick = lambda by: F.get(F.array(*map(F.lit, by)), (k % 4).cast("int"))
    path = lambda n: F.when(k % 4 == 0, F.concat(F.lit("/article/show/9/"), k * 10 + n)).otherwise(F.concat(F.lit(f"/system/2026/02/0{n}/"), k * 10 + n, F.lit(".shtml")))
    link = lambda n, title: F.concat(F.lit("<li><a href='"), path(n), F.lit("'>"), title, F.lit(f"</a> 2026-02-0{n}</li>"))
    page = F.concat(F.lit("<ul>"), link(1, pick([w for _, w, _ in kinds])), link(2, pick([w for _, w, _ in kinds])), F.when(k % 3 == 0, link(1, pick([w for _, w, _ in kinds]))).otherwise(link(3, pick([o for *_, o in kinds]))), F.lit("</ul>"))
    pages = s.select(pick([x for x, *_ in kinds]).alias("site"), F.concat(F.lit("https://"), pick([sites.SITES[x].hosts[1] for x, *_ in kinds]), F.lit("/"), k).alias("url"), page.alias("html"))
    found = sites.since(sites.index_candidates(pages), "2026-02-01", "2026-02-28", 2)
    return found.select("site", F.regexp_extract("index_url", "([0-9]+)$", 1).cast("long").alias("s_suppkey"), "place", "opportunity_id", "published_at", F.regexp_extract("url", "https://[^/]+(.*)", 1).alias("path"))


QUERIES = {f.__name__: f for f in (notice_facts, notice_events, notice_products, table_products, search_list, page_links, decoded_pages, site_notices, site_candidates)}

ORACLE_SQL = {
    "notice_facts": """
        SELECT o_orderkey, CASE WHEN k % 7 <> 0 THEN 'ORD-' || k END AS project_number, '床 ' || k || ' 采购项目' AS project_name, '客户 ' || o_custkey AS buyer_name, '天津' AS region,
               strftime(at_day, '%Y-%m-%d') AS published_at, strftime(at_day + INTERVAL 5 DAYS, '%Y-%m-%d') || 'T' || (k % 4 + 14) || ':30:00+08:00' AS registration_deadline,
               CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 11 = 0 THEN strftime(at_day + INTERVAL 21 DAYS, '%Y-%m-%d') || 'T00:00:00+08:00' ELSE strftime(at_day + INTERVAL 20 DAYS, '%Y-%m-%d') || 'T09:30:00+08:00' END END AS bid_deadline,
               (k % 1000 * 10000 + k % 10 * 1000)::BIGINT AS budget_cny, CASE WHEN k % 7 = 0 THEN 'PROJECT_NUMBER_NOT_FOUND' END AS error_code, CASE WHEN k % 2 = 0 THEN '022-1234567' END AS phone
        FROM (SELECT *, o_orderkey AS k, o_orderdate + INTERVAL 20 YEARS AS at_day FROM orders)""",
    "notice_events": """
        SELECT o_orderkey, CASE WHEN ends THEN 'TERMINATION' ELSE 'CORRECTION' END AS event_type, 'T-' || k AS project_number, strftime(at_day, '%Y-%m-%d') AS published_at,
               CASE WHEN ends OR bare THEN '' ELSE 'facts.bid_deadline' END AS changed, CASE WHEN NOT ends AND NOT bare AND k % 3 <> 1 THEN strftime(at_day + INTERVAL 9 DAYS, '%Y-%m-%d') || 'T14:05:00+08:00' END AS bid_deadline,
               CASE WHEN ends THEN '' WHEN bare THEN '__unparsed_correction__' WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN 'facts.bid_deadline' ELSE '__material_correction__' END AS unresolved,
               NOT ends AND (bare OR k % 3 <> 0) AS requires_reconciliation, ends AS terminal
        FROM (SELECT o_orderkey, o_orderkey AS k, o_orderdate + INTERVAL 20 YEARS AS at_day, o_orderkey % 4 = 0 AS ends, o_orderkey % 5 = 0 AS bare FROM orders)""",
    "notice_products": """
        SELECT p_partkey, 0 AS place, replace(p_name, ' ', '') || '分析仪' AS raw_name, CASE p_partkey % 7 WHEN 1 THEN p_size || '套' WHEN 6 THEN NULL ELSE p_size || '台' END AS quantity FROM part""",
    "table_products": """
        SELECT p_partkey, p_name AS raw_name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS category, CASE WHEN p_partkey % 5 = 0 THEN '约2台' ELSE p_size || '台' END AS quantity
        FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 <> 0""",
    "search_list": """
        SELECT s_suppkey, s_name AS title, 'https://h.example/n/' || s_suppkey AS url, '2024-01-0' || (s_suppkey % 9 + 1) AS published_at, '甲' || s_nationkey AS buyer_name,
               CASE s_suppkey % 3 WHEN 0 THEN '北京市海淀区' WHEN 1 THEN '天津' END AS region, CASE s_suppkey % 3 WHEN 0 THEN '公开招标' WHEN 1 THEN '公开招标公告' END AS notice_type FROM supplier""",
    "site_notices": """
        WITH p AS (SELECT p_partkey AS k, p_size AS n, '监护仪' || p_partkey AS name, DATE '2026-01-01' + (p_partkey % 27)::INT AS d, p_partkey % 8 AS s FROM part),
        e AS (SELECT *, CASE WHEN k % 9 = 0 AND s = 3 THEN 'TJFCH_DETAIL_PUBLISHED_DATE_NOT_CONFIRMED' WHEN k % 9 = 0 AND s IN (0, 5, 6, 7) THEN ['TEDA', '', '', '', '', 'TJZXFC', 'TJZYEFY', 'TJZYEFY_INTENT'][s + 1] || '_PUBLISHED_DATE_MISMATCH'
                             WHEN k % 9 = 1 AND s <> 1 THEN ['TEDA', '', 'TJNOTHOP', 'TJFCH', 'TJFCH_TEST', 'TJZXFC', 'TJZYEFY', 'TJZYEFY_INTENT'][s + 1] || '_TITLE_MISMATCH' END AS error_code,
                     d + CASE WHEN k % 9 = 0 AND s = 2 THEN 1 ELSE 0 END AS told, strftime(d + 9, '%Y-%m-%d') AS u FROM p),
        f AS (SELECT *, error_code IS NULL AS ok FROM e)
        SELECT k AS p_partkey, ['teda_', 'tjmugh_', 'tjnothop_', 'tjfch_', 'tjfch_', 'tjzxfc_', 'tjzyefy_', 'tjzyefy_intent_'][s + 1] || CASE WHEN s = 0 THEN '' ELSE strftime(d, '%Y%m%d') || '_' END || k AS opportunity_id, error_code,
               CASE WHEN ok THEN strftime(told, '%Y-%m-%d') END AS published_at,
               CASE WHEN ok THEN CASE s WHEN 0 THEN u || 'T15:05:00+08:00' WHEN 1 THEN u || 'T09:30:00+08:00' WHEN 2 THEN u WHEN 3 THEN u || 'T09:30:00+08:00' WHEN 5 THEN u WHEN 6 THEN u || 'T16:00:00+08:00' END END AS until,
               CASE WHEN ok THEN CASE s WHEN 0 THEN n * 10000 + 5000 WHEN 2 THEN n * 10000 WHEN 3 THEN n * 1000 END END::BIGINT AS budget_cny, CASE WHEN ok THEN [1, 2, 1, 0, 0, 2, 2, 1][s + 1] END::INT AS n_items,
               CASE WHEN ok AND s NOT IN (3, 4) THEN name END AS raw_name, CASE WHEN ok AND s IN (0, 2) THEN n || '台' END AS quantity, CASE WHEN ok AND s = 0 THEN '彩色' END AS specification,
               CASE WHEN ok THEN CASE WHEN s = 1 THEN '0221234567' WHEN s IN (5, 6, 7) THEN '022-12345678' WHEN s IN (0, 2) THEN '022-1234567' ELSE NULLIF(phone, '') END END AS phone,
               CASE WHEN ok THEN CASE WHEN s IN (2, 5) THEN 'DEADLINE_TIME_NOT_PUBLISHED' WHEN s = 4 THEN 'RELATIVE_REGISTRATION_WINDOW_7_DAYS' WHEN s = 7 THEN 'EXPECTED_PROCUREMENT_MONTH_WINDOW_UNSTRUCTURED,EXPECTED_PROCUREMENT_MONTH_WINDOW_TEXT=2026年' || (k % 9 + 1) || '月' ELSE '' END END AS flags,
               CASE WHEN ok THEN [11, 10, 11, 12, 8, 10, 10, 9][s + 1] END::INT AS n_proofs
        FROM f, (SELECT '022-1234567' AS phone)""",
    "site_candidates": """
        WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS s, unnest([1, 2]) AS n FROM supplier)
        SELECT ['teda', 'tjnothop', 'tjfch', 'tjzyefy_intent'][s + 1] AS site, k AS s_suppkey, CASE WHEN s = 0 THEN n - 1 ELSE 2 - n END::INT AS place,
               ['teda_', 'tjnothop_2026020' || n || '_', 'tjfch_2026020' || n || '_', 'tjzyefy_intent_2026020' || n || '_'][s + 1] || (k * 10 + n) AS opportunity_id, '2026-02-0' || n AS published_at,
               CASE WHEN s = 0 THEN '/article/show/9/' || (k * 10 + n) ELSE '/system/2026/02/0' || n || '/' || (k * 10 + n) || '.shtml' END AS path FROM s""",
    "page_links": """
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://h.example/p/' || page_id WHEN 1 THEN 'https://h.example/list?page=' || page_id END AS next_url, (CASE page_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 4 END)::INT AS n_chars FROM pages""",
    "decoded_pages": "SELECT page_id, sha256('<meta charset=utf-8>医疗设备' || html) AS text_sha256 FROM pages",
}
