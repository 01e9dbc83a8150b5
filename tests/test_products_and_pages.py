"""Products in words and tables, pages in other charsets, result lists and next pages, on invented notices."""

from pyspark.sql import functions as F

from sievegrid.functions import html, notices, products, text


def items(spark, column):
    return [tuple(x) for x in spark.range(1).select(column.alias("x")).first().x]


def of(f, said):
    return f(F.lit(said))


def test_primary_subjects(spark):
    said = "采购需求： 标项一 主要标的名称：全自动生化分析仪 ；数量：2 台；预算 1 万元 主要标的名称：设备一批；数量：1批； 主要标的名称：免疫 试剂盒；数量：十盒。 合同履行期限：主要标的名称：CT；数量：1台；"
    assert items(spark, of(products.primary_subjects, said)) == [("全自动生化分析仪", None, "2 台", None), ("免疫 试剂盒", None, "十盒", None)]
    assert items(spark, of(products.primary_subjects, "主要标的名称：CT；数量：1台；")) == []


def test_brief_descriptions(spark):
    head = "采购需求： 简要规格描述或项目基本概况介绍、用途："
    assert items(spark, of(products.brief_descriptions, head + "彩色超声诊断仪2台及便携式监护仪1套。 备注：无")) == [("彩色超声诊断仪", None, "2台", None), ("及便携式监护仪", None, "1套", None)]
    assert items(spark, of(products.brief_descriptions, head + "采购病理切片扫描系统，详见附件 备注：无")) == [("病理切片扫描系统", None, None, None)]
    assert items(spark, of(products.brief_descriptions, head + "一标段：眼压计采购，一批 标项二 " + head[6:] + "1、办公 备注：")) == [("眼压计", None, None, None)]


def test_demand_items(spark):
    said = "采购需求：包1:呼吸机：预算金额：20万元、数量：2台，包2:监护仪、数量：1 套；拟采购病理数字化切片扫描仪4套；为满足需要，移动床旁DR机采购2台，详见附件。合同履行期限"
    assert items(spark, of(products.demand_items, said)) == [("呼吸机", None, "2台", None), ("监护仪", None, "1 套", None), ("病理数字化切片扫描仪", None, "4套", None), ("移动床旁DR机", None, "2台", None)]


def test_lists_by_lines(spark):
    three = "采购需求\n序号\n产品名称\n数量\n1\n心电图机\n2台\n2\n离心机\n 3 台\n合同履行期限\n3\n显微镜\n1台"
    assert items(spark, of(products.name_quantity_lines, three)) == [("心电图机", None, "2台", None), ("离心机", None, "3 台", None)]
    four = "采购需求\n品目号\n品目名称\n数量\n计量单位\n001包\n1\n心电图机\n2\n台\n2\n离心机\n1\n只\n投标人须以包为单位\n3\nX\n1\n台"
    assert items(spark, of(products.name_quantity_unit_lines, four)) == [("心电图机", None, "2台", None)]
    assert items(spark, of(products.name_quantity_lines, four)) == []
    assert items(spark, of(products.numbered_items, "采购需求 1、手术床 2 台：参数 1.1 无 2、无影灯 1台★")) == [("手术床", None, "2 台", None), ("无影灯", None, "1台", None)]
    assert items(spark, of(products.text_products, three)) == items(spark, of(products.name_quantity_lines, three))
    assert items(spark, of(products.text_products, "nothing")) == []
    lots = "第一包：CT 球管的采购；第2包：内镜；第一包：CT 球管的采购；"
    assert items(spark, of(products.package_products, lots)) == [("CT 球管", None, None, None), ("内镜", None, None, None)]


def grid(rows):
    return F.array(*[F.array(*map(F.lit, r)) for r in rows])


def test_tables(spark):
    standard = grid([["表"], ["品目 名称", "采购标的", "数量（单位）", "技术要求"], ["影像", "CT机", "1台", "64排"], ["影像", "CT机", "1台", "64排"], ["影像", "-", "1台", ""], ["少"], ["检验", "离心机：", "2", "/"]])
    want = [("CT机", "影像", "1台", "64排"), ("离心机", "检验", "2", None)]
    assert items(spark, products.standard_rows(standard)) == want
    general = grid([["序号", "货物名称", "数量", "单位"], ["1", "手术床", "2", "台"], ["2", "3", "1", "台"], ["3", "无影灯", "约2", "台"], ["4", "推车", "1", "只"], ["5", "吊塔", "1套", "套"], ["备注：无", "", "", ""], ["6", "床", "1", "张"]])
    assert items(spark, products.general_rows(general)) == [("手术床", None, "2台", None), ("吊塔", None, "1套", None)]
    assert items(spark, products.table_products(F.array(general, standard))) == want
    page = "<table><tr><th>设备名称</th><th>数量</th></tr><tr><td>CT机</td><td>1台</td></tr></table>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    assert [[tuple(x) for x in r.x] for r in df.select(products.table_products(html.tables("h")).alias("x")).collect()] == [[("CT机", None, "1台", None)], []]
    evidence = F.array(F.struct(F.lit("facts.product_items").alias("field_path"), F.lit("old").alias("source_url"), F.lit("l").alias("locator")))
    r = spark.range(1).select(products.product_evidence(evidence, products.standard_rows(standard), F.lit("new")).alias("a"), products.product_evidence(evidence, products.standard_rows(grid([["x"]])), F.lit("new")).alias("b")).first()
    assert [(x.field_path, x.source_url) for x in r.a] == [("facts.product_categories", "new"), ("facts.product_items", "new")] and [x.source_url for x in r.b] == ["old"]


def test_products_of_a_record(spark):
    item = "struct<raw_name:string,category:string,quantity:string,specification:string>"
    kinds = f"known array<{item}>, cats array<string>, evidence array<struct<field_path:string,source_url:string,locator:string>>, words array<{item}>, tables array<{item}>"
    a, b, c = ("a", None, None, None), ("b", "K", "1台", None), ("c", "K", None, None)
    old = [("facts.product_items", "u", "old"), ("facts.region", "u", "r")]
    rows = [([a], ["old"], old, [b], [c, b]), ([], [], old, [a], []), ([a], ["old"], old, [b], []), (None, None, None, [], [])]
    made = products.with_structured(*[F.col(x) for x in ("known", "cats", "evidence", "words", "tables")], F.lit("n"))
    got = [r.m for r in spark.createDataFrame(rows, kinds).select(made.alias("m")).collect()]
    assert [[tuple(i) for i in m.product_items or []] for m in got] == [[c, b], [a], [a], []]
    assert [m.product_categories for m in got] == [["K"], [], ["old"], None]
    assert [[(e.field_path, e.locator) for e in m.evidence or []] for m in got] == [
        [("facts.region", "r"), ("facts.product_categories", products.TABLE_CATEGORIES), ("facts.product_items", products.TABLE_ITEMS)], [("facts.region", "r"), ("facts.product_items", products.TEXT_ITEMS)],
        [(p, w) for p, _, w in old], [],
    ]


def test_charsets(spark):
    page = "<meta charset=gb2312>天津市 医疗设备"
    rows = [(page.encode("gb18030"), None), ("plain".encode(), "gbk"), ("医院".encode("gb18030"), "nonsense"), (b"\xff\xfe\xfa", None), (None, None)]
    df = spark.createDataFrame([(None if b is None else bytearray(b), c) for b, c in rows], "b binary, c string")
    got = [r.t for r in df.select(html.decode_best("b", F.col("c")).alias("t")).collect()]
    assert got[0] == page and got[1:3] == ["plain", "医院"] and got[4] is None and "�" in got[3]
    assert df.limit(1).select(html.decode_best("b", F.col("c"), {"医疗设备": 30}).alias("t")).first().t == page


def test_lists_and_next_pages(spark):
    page = '<ul class="a vT-srch-result-list-bid"><li><a href=" /1 ">A <b>b</b></a> 2024.1.5 <span>| 天津</span><ul><li><a href="/x">no</a></li></ul></li><li>none</li></ul><li><a href="/y">out</a></li>'
    df = spark.createDataFrame([(page,), (None,)], "h string")
    got = df.select(html.list_rows("h").alias("x")).collect()
    assert [tuple(x) for x in got[0].x] == [("A b", "/1", "2024.1.5 | 天津")] and got[1].x == []
    base = F.lit("https://h.example/list/1")
    pages = ['<a href="2">下一页</a>', '<link rel="prev" href="0"><link rel="NEXT other" href="3"><a rel=next href="4">x</a>', '<a href="https://other.example/2">next</a>', '<a href="1">Next</a>', "<a>next</a>", ""]
    got = spark.range(1).select(F.array(*[html.next_page(F.lit(p), base, ["h.example"]) for p in pages]).alias("x")).first().x
    assert got == ["https://h.example/list/2", "https://h.example/list/3", None, None, None, None]
    assert spark.range(1).select(html.regex_text(F.lit("<p>a&nbsp;&amp;&lt;b<script>x</script> <i>c</i>")).alias("x")).first().x == "a &<b c"


def test_notice_names(spark):
    said = "项目编号：TJ-9)公开招标公告 项目名称：甲 院 CT 采购 预算金额：10万元 采购人信息 名称：甲 医院 地址：路1号 3. 项目联系方式 项目联系人：Contact A 联系电话：12 34"
    r = spark.range(1).select(notices.project_number(F.lit(said)).alias("a"), notices.project_name(F.lit(said)).alias("b"), notices.buyer(F.lit(said)).alias("c"), notices.contact(F.lit(said)).alias("d")).first()
    assert (r.a, r.b, r.c) == ("TJ-9", "甲 院 CT 采购", "甲 医院") and (r.d.title, r.d.phone, r.d.email) == ("项目联系人", None, None)
    long = "二、更正信息 " + "字" * 3000 + " 三、其他补充事宜"
    x = spark.range(1).select(notices.event_facts(F.lit("更正公告 项目编号：T 更正日期：2024-03-05 " + long)).alias("x")).first().x
    assert len(x.summary) == 2400
    assert spark.range(1).select(text.section(F.lit("a" * 50), "^", "$", 10).alias("a"), text.section(F.lit("a" * 50), "^", "$", None, cut=10).alias("b")).first().asDict() == {"a": None, "b": "a" * 10}
