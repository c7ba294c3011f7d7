"""Table lines as filings print them: what must come out of each."""

import pytest

from brightledger.operators import figures

# name: pages, and by metric what is expected of value, prior value, change and others (a missing metric must be missing)
CASES = {
    "summary": (["公司半年度报告摘要 主要会计数据 单位：人民币万元 营业收入 1,234,567.89 上年同期 1,100,000 归属于上市公司股东的净利润 123,456.78 基本每股收益 2.35 加权平均净资产收益率 18.42%"],
                {"revenue": dict(value=12345678900), "net_profit": dict(value=1234567800), "eps": dict(value=2.35), "roe": dict(value=18.42)}),
    "rival note": (["财务报表附注 单位：元 营业收入 88888888", "报告摘要 主要财务指标 单位：元 营业收入 99999999"], {"revenue": dict(value=99999999, confidence_below=0.9)}),
    "bare footnote": (["主要会计数据 单位：人民币千元 营业总收入 78,025,359 基本每股收益（元/股）1 0.58 加权平均净资产收益率 3.65%"], {"eps": dict(value=0.58), "revenue": dict(value=78025359000)}),
    "lone whole number": (["主要会计数据 单位：元 基本每股收益（元/股）2 加权平均净资产收益率 10%"], {"eps": dict(value=2)}),
    "footnotes in brackets": (["主要会计数据 单位：人民币千元 基本每股收益（元/股）(1) 0.58 0.75 加权平均净资产收益率 (1) 3.65% 4.12%"], {"eps": dict(value=0.58), "roe": dict(value=3.65)}),
    "unit in the label": (["主要会计数据 营业收入（千元） 260,042,490 250,000,000 4.02% 归属于上市公司股东的净利润（千元） 20,123,456 基本每股收益（元/股） 2.35"],
                          {"revenue": dict(value=260042490000, prior=250000000000, change=4.02), "net_profit": dict(value=20123456000), "eps": dict(value=2.35)}),
    "label beats page": (["主要会计数据 单位：人民币元 营业收入（千元） 260,042,490 归属于上市公司股东的净利润（万元） 1,234.5 基本每股收益 2.35"], {"revenue": dict(value=260042490000), "net_profit": dict(value=12345000)}),
    "unit in a note": (["主要会计数据（人民币千元，特别注明除外）营业总收入 10,000 归属于上市公司股东的净利润 500 基本每股收益 0.12"], {"revenue": dict(value=1e7), "net_profit": dict(value=5e5), "eps": dict(value=0.12)}),
    "a year is no figure": (["主要会计数据 基本每股收益 2026"], {"eps": None}),
    "bank labels": (["本集团主要会计数据和财务指标（人民币百万元，特别注明除外）营业收入 178,181 169,969 归属于本行股东的净利润 76,445 74,930 归属于本行普通股股东的基本每股收益 (1) 2.98 2.89 归属于本行普通股股东的加权平均净资产收益率 (1) 13.42 13.85 扣除非经常性损益后加权平均净资产收益率 13.40"],
                    {"revenue": dict(value=178181e6), "net_profit": dict(value=76445e6), "eps": dict(value=2.98), "roe": dict(value=13.42)}),
    "statements": (["合并资产负债表 单位：人民币百万元 资产总计 4,200,000 负债合计 3,600,000", "合并现金流量表 单位：人民币百万元 经营活动产生的现金流量净额 -12,500", "合并利润表 单位：人民币百万元 营业收入 178,181 营业总成本 120,000 营业成本 110,000"],
                   {"total_assets": dict(value=42e11), "total_liabilities": dict(value=36e11), "operating_cash_flow": dict(value=-125e8), "operating_cost": dict(value=11e10)}),
    "negative in brackets": (["合并现金流量表 单位：元 经营活动产生的现金流量净额 (500000) 1000000"], {"operating_cash_flow": dict(value=-500000)}),
    "another cost": (["合并利润表 单位：元 营业总成本 80000"], {"operating_cost": None}),
    "three columns": (["经营业绩 2026 年 1-6 月 2025 年 1-6 月 同比增减 单位：人民币千元 营业收入 78,025,359 71,552,734 9.05% 归属于上市公司股东的净利润 2,752,825 5,057,571 (45.57%) 经营活动产生的现金流量净额 (126,600) 1,299,408 (109.74%)"],
                      {"revenue": dict(value=78025359000, prior=71552734000, change=9.05), "net_profit": dict(value=2752825000, prior=5057571000, change=-45.57), "operating_cash_flow": dict(value=-126600000, prior=1299408000, change=-109.74)}),
    "restated": (["主要会计数据和财务指标 营业收入（元） 6,067,620,945.86 2,402,761,037.13 2,402,761,037.13 152.53% 16,504,791,211.36 归属于上市公司股东的净利润（元） 2,384,798,239.47 780,930,777.06 780,930,777.06 205.38% 6,327,092,507.84 基本每股收益（元/股） 2.4 1.1 0.79 203.80% 6.37 加权平均净资产收益率 20.81% 12.45% 6.81% 14.00% 55.20%"],
                 {"revenue": dict(value=6067620945.86, prior=2402761037.13, change=152.53), "net_profit": dict(value=2384798239.47, prior=780930777.06, change=205.38), "eps": dict(value=2.4, prior=0.79, change=203.8), "roe": dict(value=20.81, prior=6.81, change=None)}),
    "restated without signs": (["主要会计数据和财务指标 单位：万元 营业收入 4,010,041.08 3,455,176.54 5,070,045.48 -20.91 11,808,310.93 归属于上市公司股东的净利润 507,454.60 484,454.78 691,272.05 -26.59 1,271,300.40 基本每股收益（元/股） 0.52 0.55 0.71 -26.77 1.31 加权平均净资产收益（%） 5.72 5.60 5.25 0.48 13.74 16.92 16.57 减少 2.82 个百分点"],
                               {"revenue": dict(value=40100410800, prior=50700454800, change=-20.91), "net_profit": dict(value=5074546000, prior=6912720500, change=-26.59), "eps": dict(value=0.52, prior=0.71, change=-26.77), "roe": dict(value=5.72, prior=5.25, change=None)}),
    "bare change, year to date": (["主要会计数据 营业收入 40,267,482,684.56 3.08 130,970,743,649.04 1.96 归属于上市公司股东的净利润 19,950,545,560.09 3.78 64,467,425,981.95 -0.25 基本每股收益（元/股） 15.96 3.78 51.53 -0.25 加权平均净资产收益率（%） 7.64 0.12 个百分点"],
                                  {"revenue": dict(value=40267482684.56, prior=None, change=3.08), "net_profit": dict(value=19950545560.09, prior=None, change=3.78), "eps": dict(value=15.96, prior=None, change=3.78)}),
    "small bare change": (["主要会计数据 量净额 基本每股收益（元/股） 15.35 0.77 51.53 6.43 稀释每股收益（元/股） 15.35 0.77 51.53 6.43"], {"eps": dict(value=15.35, prior=None, change=0.77)}),
    "large bare change": (["主要会计数据 归属于上市公司股东的净利润 4,208,900,978.28 728.93 11,065,687,391.96 921.55 基本每股收益（元/股） 6.00 689.47 15.83 865.24"], {"eps": dict(value=6, prior=None, change=689.47), "net_profit": dict(value=4208900978.28, prior=None, change=728.93)}),
    "explained changes": (["一、主要财务数据 （一）主要会计数据和财务指标 单位：千元 币种：人民币 营业收入 383,553,853 57.73 941,414,498 55.88 归属于上市公司股东的净利润 16,634,153 60.35 40,374,611 79.55",
                           "基本每股收益（元/股） 0.84 61.54 2.04 80.53 稀释每股收益（元/股） 0.84 61.54 2.04 80.53 加权平均净资产收益率（%） 8.41 增加 1.79 个百分点 21.77 总资产 580,017,053", "非经常性损益项目和金额",
                           "（三）主要会计数据、财务指标发生变动的情况、原因 项目名称 变动比例（%） 主要原因 营业收入-本报告期 57.73 归属于上市公司股东的净利润-本报告期 60.35 基本每股收益（元/股）-本报告期 61.54 基本每股收益（元/股）-年初至报告期末 80.53"],
                          {"eps": dict(value=0.84, prior=None, change=61.54, page=2), "net_profit": dict(value=16634153000, change=60.35, page=1)}),
    "no prior from a sibling": (["主要会计数据 基本每股收益（元/股） 15.35 0.77 51.53 6.43", "基本每股收益（元/股） 15.35 0.77"], {"eps": dict(value=15.35, prior=None, change=0.77)}),
    "change at once": (["主要会计数据 营业收入（千元） 165,220,844 58.58% 442,137,424 56.19% 基本每股收益（元/股） 1.23 8.00% 3.21 10.00% 加权平均净资产收益率 5.60% 1.20 个百分点 12.30% 0.80 个百分点"], {"revenue": dict(value=165220844000, prior=None, change=58.58), "eps": dict(value=1.23, change=8)}),
    "no scale on per cents": (["主要会计数据 单位：人民币千元 营业收入 10,000 8,000 (20.00%)"], {"revenue": dict(value=1e7, prior=8e6, change=-20)}),
    "inside another label": (["报告摘要 主要会计数据 单位：人民币百万元 归属于母公司股东的净利润 146,500 扣除非经常性损益后归属于母公司股东的净利润 146,449 基本每股收益 1.20"],
                             {"non_recurring_pnl": None, "profit_ex_non_recurring": dict(value=146449e6, label="扣除非经常性损益后归属于母公司股东的净利润"), "net_profit": dict(value=1465e8)}),
    "beside the other": (["报告摘要 主要会计数据 单位：人民币万元 归属于母公司股东的净利润 150,000 扣除非经常性损益后归属于母公司股东的净利润 146,449 非经常性损益合计 3,551"], {"non_recurring_pnl": dict(value=35510000), "profit_ex_non_recurring": dict(value=1464490000)}),
    "period stub": (["主要会计数据（人民币百万元）扣除非经常性损益后归属于本行股东的净利润 2026 年 7-9 月 13,491 同比增 1.1%"], {"profit_ex_non_recurring": dict(value=13491e6), "net_profit": None, "non_recurring_pnl": None}),
    "note on a label": (["单位：千元 基本每股收益注 1 0.58 1.06 (45.28%) 加权平均净资产收益率注 1 3.65% 6.85%"], {"eps": dict(value=0.58, prior=1.06, change=-45.28), "roe": dict(value=3.65)}),
    "change, year to date": (["（货币单位：人民币百万元） 营业收入 32,483 3.8% 103,100 2.4% 基本/稀释每股收益（元/股） 0.70 1.4% 1.94 3.7% 加权平均净资产收益率（未年化） 2.85% -0.18 个百分点 8.07% -0.21 个百分点"],
                             {"revenue": dict(value=32483e6, prior=None, change=3.8), "roe": dict(value=2.85, prior=None)}),
    "signed bare change": (["主要会计数据 单位：人民币百万元 营业收入 84,916 4.75 245,648 5.68 归属于上市公司股东的净利润 2,167 -29.67 6,739 -15.33 基本每股收益（元/股） 0.10 -28.57 0.31 -16.22"],
                           {"revenue": dict(prior=None, change=4.75), "net_profit": dict(value=2167e6, prior=None, change=-29.67), "eps": dict(value=0.1, prior=None, change=-28.57)}),
    "change above the figure": (["主要会计数据 单位：人民币万元 营业收入 4,387,179.48 9.40 12,276,630.88 3.97 基本每股收益（元/股） 0.60 15.13 1.76 34.23"], {"eps": dict(value=0.6, prior=None, change=15.13), "revenue": dict(change=9.4)}),
    "small shares": (["主要会计数据 归属于本行普通股股东的基本每股收益（人民币元） 1.59 3.25 4.57 3.16"], {"eps": dict(value=1.59, prior=None, change=3.25)}),
    "points, year to date": (["主要会计数据 加权平均净资产收益率（%） 5.80 0.07 16.70 2.95"], {"roe": dict(value=5.8, prior=None)}),
    "full width": (["主要会计数据 单位：人民币百万元 营业收入 32,483 3.8％ 103,100 2.4％"], {"revenue": dict(prior=None, change=3.8)}),
    "later change": (["主要财务指标 加权平均净资产收益率（%） 4.53 -2.62 增加7.15个百分点 扣除非经常性损益后的加权平均净资产收益率（%） 4.40 -2.80 增加7.20个百分点 同比增长 44.67% 说明详见附注"], {"roe": dict(value=4.53, prior=-2.62, label="加权平均净资产收益率")}),
    "two per cents": (["报告摘要 主要财务指标 加权平均净资产收益率 12.08% 10.50%"], {"roe": dict(value=12.08, prior=10.5)}),
    "lent by the summary": (["报告摘要 主要会计数据 单位：人民币千元 归属于上市公司股东的净利润 2,752,825 5,057,571 (45.57%)", "合并利润表 单位：人民币千元 归属于母公司股东的净利润 2,752,825 5,617,745"], {"net_profit": dict(value=2752825000, prior=5057571000, change=-45.57)}),
    "broken amounts": (["主要会计数据\n营业收入\n（元）\n40,476,58\n5,676.17\n41,062,20\n7,706.33 -1.55%\n归属于上市公司股东的净利润\n（元）\n683,401,8\n93.00\n697,255,6\n48.40 -1.34%\n基本每股收益（元/股） 0.46"], {"revenue": dict(value=40476585676.17, prior=41062207706.33, change=-1.55), "net_profit": dict(value=683401893)}),
    "broken at the comma": (["主要会计数据 单位：元\n营业收入\n25,936,555,\n155.04\n28,644,269,964.50 -9.76%"], {"revenue": dict(value=25936555155.04)}),
    "unit before the currency": (["主要会计数据 单位：百万元人民币（另有说明者除外） 营业收入 169,462 4.48 526,365 7.16 基本和稀释每股收益（人民币元） 0.19 3.98 0.55 0.27 加权平均净资产收益率（%，年化） 8.90 上升 0.18 个百分点"], {"revenue": dict(value=169462e6), "eps": dict(value=0.19), "roe": dict(value=8.9)}),
    "yearly rate": (["主要会计数据 单位：人民币百万元 营业收入 202,410 12.81% 归属于本行股东的净利润 104,662 9.84% 基本和稀释每股收益（人民币元） 0.38 8.57% 年化加权平均净资产收益率(%) 11.18"], {"eps": dict(value=0.38), "net_profit": dict(value=104662e6), "roe": dict(value=11.18)}),
    "diluted first": (["主要财务指标 基本每股收益 (1.0075) 净资产收益率（全面摊薄） -6.24% 净资产收益率（加权平均） -6.07% -4.00% 下降 2.16 个百分点"], {"roe": dict(value=-6.07), "eps": dict(value=-1.0075)}),
    "dash for a change": (["1 财务摘要 （除特别注明外，以人民币百万元列示） 营业收入 436,529 394,273 10.72 385,965 基本和稀释每股收益 2 0.65 0.65 - 0.66 扣除非经常性损益后的基本和稀释每股收益 1 0.64 0.65 (1.54) 0.66 年化加权平均净资产收益率 2 9.52 10.08 (0.56) 10.82"],
                          {"eps": dict(value=0.65, prior=0.65, label="基本和稀释每股收益"), "roe": dict(value=9.52)}),
    "three years": (["财务摘要 单位：百万元人民币 基本每股收益（元） 0.36 0.36 0.36 净资产收益率（%） 5 8.66 9.11 9.58 净息差（%） 6 1.27"], {"eps": dict(value=0.36, prior=0.36, change=None), "roe": dict(value=8.66, prior=9.11, label="净资产收益率")}),
    "change in money": (["利润表主要项目 单位：百万元人民币 营业收入 356,903 329,003 27,900 8.48% 归属于母公司所有者的净利润 123,594 117,591 6,003 5.10%"], {"revenue": dict(value=356903e6, prior=329003e6, change=8.48), "net_profit": dict(prior=117591e6, change=5.1)}),
    "nothing": ([None, "", "没有数字 营业收入"], {"revenue": None}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, i + 1, text) for name, (pages, _) in CASES.items() for i, text in enumerate(pages)]
    out = {}
    for r in figures.metrics(spark.createDataFrame(rows, "report string, page int, content string").repartition(3), "report").collect():
        out.setdefault(r["report"], {})[r["metric"]] = r
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    own = found.get(name, {})
    for metric, want in CASES[name][1].items():
        if want is None:
            assert metric not in own
            continue
        got = own[metric]
        for field, column in (("value", "value"), ("prior", "prior_value"), ("change", "yoy_pct")):
            if field in want:
                assert got[column] == (None if want[field] is None else pytest.approx(want[field], rel=1e-12)), (metric, field, got)
        assert got["confidence"] < want.get("confidence_below", 1) and got["source_page"] == want.get("page", got["source_page"])
        assert got["source_label"] == want.get("label", got["source_label"])
