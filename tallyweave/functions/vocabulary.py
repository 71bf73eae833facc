"""Fixed values of the accounting domain: word lists, tables and thresholds.

They decide results and are stated as data. The chart of accounts itself is no constant; it is
always a DataFrame parameter.
"""

from __future__ import annotations

# Amount split modes and the texts of a source direction.
SPLIT_MODES = ("two_column", "single_by_direction", "single_by_source_direction", "single_as_debit", "single_as_credit")
DEBIT_TEXTS = ("借", "借方", "debit", "dr")
CREDIT_TEXTS = ("贷", "贷方", "credit", "cr")
FLAT_TEXTS = ("", "平", "flat", "balanced")

# Texts that stand for no amount.
BLANK_AMOUNTS = ("", "None", "—", "-", "·")

# Rows that are no business rows.
SUMMARY_WORDS = ("合计", "总计", "小计", "累计")
FOOTER_WORDS = ("核算单位", "制单人", "打印时间", "打印日期", "编制单位", "审核人", "记账人", "财务主管", "单位负责人")
CONFIG_WORDS = ("不过帐", "不记帐", "不记账", "设置用", "系统设置", "暂存")
AUXILIARY_PREFIXES = ("客户", "供应商", "部门", "项目", "银行账户", "员工")

# What a header row looks like.
HEADER_ANCHORS = ("科目编码", "科目代码", "科目编号", "科目号", "科目名称", "科目名", "科目全称", "科目类别")
HEADER_WORDS = ("科目", "余额", "金额", "借方", "贷方", "发生", "累计", "期初", "期末", "年初", "年末", "数量", "币种", "公司", "核算项目", "年", "级次")
COMPANY_SUFFIXES = ("公司", "工厂", "银行", "支行", "营业部", "基金", "信托")
AMBIGUOUS_HEADERS = ("借", "借方", "贷", "贷方", "余额", "本期", "期初", "期末", "发生额")

# Punctuation that name and header folding drops.
NAME_PUNCTUATION = "()（）[]【】{}：:；;，,。.、/_-—–·．"
TOKEN_SEPARATORS = r"[_\-—–/\\|·．、:：;；,，()（）\[\]【】{}\s]+"
DISPLAY_PREFIXES = ("减", "加", "其中")

# Accounts shown as roots whatever their code says.
ROOT_CODES = ("141101", "141102", "660201")

# Fields of each upload type.
REQUIRED_FIELDS = {
    "trial_balance": ("fiscal_year", "period", "account_code", "account_name"),
    "journal": ("fiscal_year", "period", "voucher_no", "voucher_date", "summary", "account_code", "account_name"),
    "subsidiary": ("fiscal_year", "period", "voucher_no", "voucher_date", "summary", "account_code", "account_name", "auxiliary_type"),
}
AMOUNT_FIELDS = ("opening_debit", "opening_credit", "current_debit", "current_credit", "ending_debit", "ending_credit")

# Header texts of each field.
FIELD_WORDS = {
    "account_code": ("科目编码", "科目代码", "科目号", "会计科目编码", "会计科目代码", "account code", "account_code", "acct_code", "acct code", "科目", "会计科目", "account", "account number"),
    "account_name": ("科目名称", "科目", "会计科目", "会计科目名称", "科目全称", "account name", "account_name", "acct_name", "acct name"),
    "fiscal_year": ("会计年度", "年度", "年份", "年", "fiscal year", "year", "fiscal_year"),
    "period": ("会计期间", "期间", "月份", "月", "period", "month", "会计月"),
    "voucher_no": ("凭证号", "凭证编号", "凭证号码", "传票号", "凭证字", "voucher no", "voucher_no", "voucher number", "journal no", "凭证", "voucher"),
    "voucher_date": ("凭证日期", "日期", "记账日期", "制单日期", "voucher date", "voucher_date", "date", "entry date"),
    "summary": ("摘要", "说明", "备注", "描述", "summary", "description", "explanation", "note", "摘要说明", "凭证摘要"),
    "debit_amount": ("借方金额", "借方", "借", "借方发生", "debit", "debit amount", "dr", "dr amount", "借方余额", "借方发生额"),
    "credit_amount": ("贷方金额", "贷方", "贷", "贷方发生", "credit", "credit amount", "cr", "cr amount", "贷方余额", "贷方发生额"),
    "attachment_count": ("附件数", "附件", "附单据数", "原始凭证张数", "attachment", "attachment count", "attachments"),
    "auxiliary_type": ("辅助核算类型", "辅助类型", "核算类型", "辅助核算类别", "auxiliary type", "aux_type"),
    "auxiliary_code": ("辅助核算编码", "辅助编码", "核算编码", "auxiliary code", "aux_code", "辅助核算代码"),
    "auxiliary_name": ("辅助核算名称", "辅助名称", "核算名称", "辅助核算", "auxiliary name", "aux_name", "客户名称", "供应商名称", "部门名称", "项目名称"),
    "opening_debit": ("期初借方余额", "期初借方", "期初借", "年初借方余额", "年初借方", "opening debit", "beginning debit", "期初余额(借)", "期初借方金额", "期初余额_借方", "期初余额（借）", "期初余额借方", "期初余额_借方_金额", "期初余额借方金额", "本币期初余额借方", "本币期初余额_借方"),
    "opening_credit": ("期初贷方余额", "期初贷方", "期初贷", "年初贷方余额", "年初贷方", "opening credit", "beginning credit", "期初余额(贷)", "期初贷方金额", "期初余额_贷方", "期初余额（贷）", "期初余额贷方", "期初余额_贷方_金额", "期初余额贷方金额", "本币期初余额贷方", "本币期初余额_贷方"),
    "current_debit": ("本期借方发生额", "本期借方", "借方发生额", "本期借", "current debit", "debit amount", "dr amount", "本期借方金额", "本期发生_借方", "本期发生额(借)", "本期发生额（借）", "本期发生_借方_金额", "本期发生借方金额", "本期发生额_借方", "本期发生额_借方_金额"),
    "current_credit": ("本期贷方发生额", "本期贷方", "贷方发生额", "本期贷", "current credit", "credit amount", "cr amount", "本期贷方金额", "本期发生_贷方", "本期发生额(贷)", "本期发生额（贷）", "本期发生_贷方_金额", "本期发生贷方金额", "本期发生额_贷方", "本期发生额_贷方_金额"),
    "ending_debit": ("期末借方余额", "期末借方", "期末借", "年末借方余额", "年末借方", "ending debit", "closing debit", "期末余额(借)", "期末借方金额", "期末余额_借方", "期末余额（借）", "期末余额借方", "期末余额_借方_金额", "期末余额借方金额"),
    "ending_credit": ("期末贷方余额", "期末贷方", "期末贷", "年末贷方余额", "年末贷方", "ending credit", "closing credit", "期末余额(贷)", "期末贷方金额", "期末余额_贷方", "期末余额（贷）", "期末余额贷方", "期末余额_贷方_金额", "期末余额贷方金额"),
}

# Header texts that are never a field, and the fields of each upload type in order.
VETO_WORDS = {
    "period": ("本币期间异动", "期间异动", "本期异动", "本月异动", "本币发生异动", "期间发生异动"),
    "fiscal_year": ("本币本年累计", "本年累计", "本年异动", "本年发生", "本币累计", "累计发生"),
}
_ENTRY = ("fiscal_year", "period", "voucher_no", "voucher_date", "summary", "account_code", "account_name", "debit_amount", "credit_amount")
TYPE_FIELDS = {
    "trial_balance": ("fiscal_year", "period", "account_code", "account_name", "account_level", *AMOUNT_FIELDS),
    "journal": (*_ENTRY, "attachment_count"),
    "subsidiary": (*_ENTRY, "auxiliary_type", "auxiliary_code", "auxiliary_name", "attachment_count"),
}

# Account names that anchor a client name, in order of precedence.
NAME_ANCHORS = (
    "银行存款", "库存现金", "其他货币资金", "应收账款", "预付账款", "应收票据", "其他应收款", "应付账款", "预收账款", "应付票据", "其他应付款",
    "原材料", "库存商品", "固定资产", "无形资产", "工程物资", "短期借款", "长期借款", "应付职工薪酬", "实收资本", "资本公积", "盈余公积", "未分配利润",
    "主营业务收入", "其他业务收入", "营业外收入", "主营业务成本", "其他业务成本", "营业外支出", "管理费用", "销售费用", "财务费用",
    "研发支出_资本化支出", "研发支出_费用化支出", "研发支出", "研发费用", "所得税费用", "资产减值损失", "信用减值损失", "营业税金及附加", "税金及附加",
    "递延收益", "生产成本", "制造费用", "投资收益", "其他收益", "其他权益工具投资", "合同履约成本", "存货跌价准备",
)

# Semantic groups as (group, client spellings, standard spellings, spellings that conflict), in order of precedence.
SEMANTIC_GROUPS = (
    ("prepayments", ("预付账款", "预付款", "预付款项", "预付材料款", "预付机物料款"), ("预付款项", "预付账款"), ("应收款项融资", "应收账款", "其他应收款")),
    ("accumulated_depreciation", ("累计折旧", "固定资产累计折旧"), ("固定资产累计折旧", "累计折旧"), ("固定资产原值",)),
    ("construction_in_progress", ("在建工程", "在安装设备", "工程项目", "装修费用"), ("在建工程", "在建工程原值"), ("在建工程减值准备",)),
    ("other_receivables", ("其他应收款", "备用金", "押金"), ("其他应收款",), ("应收账款", "应收款项", "其他应付款")),
    ("other_payables", ("其他应付款", "应付暂估", "应付其他"), ("其他应付款",), ("应付账款",)),
    ("tax_payable", ("应交税费", "应交税金", "应交增值税", "应交所得税", "应交城建税"), ("应交税费", "应交税金"), ()),
    ("advance_receipts", ("预收账款", "预收款项", "预收款"), ("预收款项", "预收账款", "合同负债"), ("应收账款", "预付款项")),
    ("long_term_prepaid_expense", ("长期待摊费用", "长期待摊", "待摊费用"), ("长期待摊费用",), ()),
    ("intangible_amortization", ("无形资产累计摊销", "累计摊销", "无形资产摊销"), ("无形资产累计摊销", "累计摊销"), ("无形资产原值",)),
    ("deferred_income", ("递延收益", "与资产相关的递延收益", "与收益相关的递延收益"), ("递延收益",), ()),
    ("production_cost", ("生产成本", "基本生产成本", "直接材料", "直接人工", "直接动力", "委外加工费", "委外物资"), ("生产成本",), ("农业生产成本", "主营业务成本", "主营业务收入", "应付职工薪酬")),
    ("manufacturing_overhead", ("制造费用",), ("制造费用",), ("应付职工薪酬", "管理费用", "销售费用", "研发费用")),
    ("research_expense", ("研发费用",), ("研发费用",), ("开发支出", "研发支出", "资本化支出", "费用化支出", "油气开发支出", "应付职工薪酬")),
    ("rd_capitalized_development", ("研发支出资本化支出", "资本化支出"), ("研发支出资本化支出",), ("费用化支出", "研发费用")),
    ("rd_expensed_development", ("研发支出费用化支出", "费用化支出"), ("研发支出费用化支出",), ("资本化支出", "研发费用")),
    ("development_expenditure", ("开发支出",), ("开发支出",), ("研发费用", "油气开发支出")),
    ("investment_income", ("投资收益", "交易性金融资产收益"), ("投资收益",), ("交易性金融资产", "其他收益")),
    ("other_income", ("其他收益",), ("其他收益",), ("其他综合收益", "其他应收款", "其他权益工具", "投资收益")),
    ("fixed_assets", ("固定资产",), ("固定资产", "固定资产原值"), ("固定资产累计折旧", "固定资产减值准备")),
    ("intangible_assets", ("无形资产",), ("无形资产", "无形资产原值"), ("无形资产累计摊销", "无形资产减值准备")),
    ("paid_in_capital", ("实收资本",), ("实收资本",), ("资本公积",)),
)
# Groups that the first part of a name decides, before any other spelling is tried.
ROOT_GROUPS = (("deferred_income", "递延收益"), ("production_cost", "生产成本"), ("manufacturing_overhead", "制造费用"), ("fixed_assets", "固定资产"), ("intangible_assets", "无形资产"), ("paid_in_capital", "实收资本"))

# Names too general to match without a parent.
GENERIC_NAMES = (
    "工资", "职工福利", "福利费", "社保", "公积金", "工会经费", "职工教育经费", "折旧费", "摊销费", "材料费", "水电费", "办公费", "差旅费", "交通费",
    "业务招待费", "通讯费", "租赁费", "修理费", "保险费", "聘请中介机构费", "咨询费", "诉讼费", "排污费", "绿化费", "税金", "其他费用", "其他",
    "检测费", "试验检验费", "委托外部研究开发费用", "行政管理类", "生产经营类", "充电场站", "办公租赁", "职工薪酬", "劳务费", "运输费", "装卸费", "包装费", "广告费",
)
GENERIC_STANDARD_NAMES = ("资产", "负债", "权益", "收入", "成本", "费用", "其他", "减", "加", "净", "合计", "小计", "总计", "余额", "明细", "类")
PLACEHOLDER_NAMES = ("明细科目", "明细", "xxx", "未知", "测试", "test")

# Codes of older charts and where their accounts went.
CODE_CROSSWALK = {
    "101": "1001", "102": "1002", "109": "1012", "1009": "1012", "111": "1101", "1111": "112101", "112": "112101", "113": "112201", "1131": "112201",
    "114": "112402", "115": "112401", "1151": "112401", "119": "122101", "121": "1403", "122": "1403", "123": "1403", "1231": "122102", "124": "1405",
    "128": "141101", "129": "141102", "131": "140601", "137": "1405", "139": "147101", "141": "1901", "151": "151101", "161": "160101", "165": "1602",
    "1651": "164101", "169": "160401", "171": "170101", "181": "1801", "1802": "1801", "1807": "1811", "191": "1902",
    "201": "2001", "202": "2201", "203": "2202", "204": "2203", "209": "2241", "211": "2211", "2121": "2211", "2131": "2241", "214": "2221", "2171": "2221",
    "221": "2501", "223": "2701", "229": "2241", "301": "4001", "311": "4003", "312": "4101", "313": "4101", "321": "4103", "322": "4105",
    "401": "5001", "405": "5101", "501": "6001", "502": "6401", "503": "6602", "504": "6602", "511": "6051", "512": "6402", "521": "6602", "522": "6601",
    "531": "6111", "541": "6301", "542": "6711", "550": "6801", "560": "6901",
    "4107": "660201", "6121": "6117", "2132": "2241", "2151": "2211", "2181": "2241", "5407": "6401", "5701": "6801", "5301": "660201",
}

# The account name that a code prefix stands for.
CODE_ANCHORS = {
    "1001": "库存现金", "1002": "银行存款", "1012": "其他货币资金", "1121": "应收票据", "1122": "应收账款", "1123": "预付账款", "1221": "其他应收款",
    "1401": "原材料", "1405": "库存商品", "1601": "固定资产", "1701": "无形资产", "1511": "长期股权投资", "1521": "投资性房地产", "1523": "投资性房地产",
    "1705": "使用权资产原值", "1706": "使用权资产累计折旧", "2201": "应付票据", "2202": "应付账款", "2203": "预收账款", "2211": "应付职工薪酬", "2501": "长期借款",
    "4001": "实收资本", "4101": "资本公积", "4104": "未分配利润", "6001": "主营业务收入", "6401": "主营业务成本", "6301": "营业外收入", "6601": "销售费用",
    "6602": "管理费用", "6603": "财务费用", "6604": "研发费用", "6711": "营业外支出", "6801": "所得税费用",
}

# Contra (valuation) words.
RESERVE_WORDS = ("减值准备", "资产减值损失", "坏账准备", "跌价准备", "累计折旧", "累计摊销", "减值", "准备")
RESERVE_TOKENS = ("累计折旧", "累计摊销", "坏账准备", "存货跌价准备", "减值准备", "跌价准备", "资产减值", "信用减值")
HISTORY_RESERVE_WORDS = ("减值", "准备", "坏账", "跌价", "累计折旧", "累计摊销")

# Words of opposite sides, as (in one name, in the other).
DIRECTION_OPPOSITES = (("应收", "应付"), ("预付", "预收"), ("预付", "合同负债"), ("其他应收", "其他应付"), ("应收票据", "应付票据"), ("预收", "预付"), ("应付", "应收"))
PROFIT_LOSS_OPPOSITES = (("收入", "成本"), ("收入", "费用"), ("成本", "费用"), ("营业外收入", "营业外支出"), ("营业外支出", "营业外收入"))
NEUTRAL_NAMES = ("银行", "账户", "供应商", "客户", "员工", "部门", "项目", "地区", "费用项目", "产品", "存货", "设备", "机器", "运输", "车辆", "保证金", "押金", "备用金", "个人", "内部", "公司")

# Headings of a chart, and accounts that anchor even as parents.
STRUCTURAL_NAMES = (
    "资产类", "负债类", "所有者权益类", "共同类", "成本类", "损益类", "流动资产", "非流动资产", "流动负债", "非流动负债", "期间费用", "收入类", "费用类",
    "项目核算", "部门核算", "往来核算", "明细科目", "辅助核算", "所有者权益", "权益类", "资产", "负债", "权益", "收入", "成本", "费用", "研发支出",
)
ACCOUNT_ANCHORS = (
    "银行存款", "库存现金", "其他货币资金", "应收账款", "预付账款", "其他应收款", "坏账准备", "应收票据", "应付账款", "预收账款", "其他应付款", "应付票据",
    "固定资产", "累计折旧", "在建工程", "无形资产", "长期待摊费用", "原材料", "库存商品", "周转材料", "短期借款", "长期借款", "实收资本", "资本公积", "盈余公积",
    "未分配利润", "本年利润", "利润分配", "生产成本", "制造费用", "主营业务收入", "其他业务收入", "营业外收入", "主营业务成本", "其他业务成本",
    "销售费用", "管理费用", "财务费用", "营业外支出", "所得税费用", "研发费用", "开发支出",
)
# Words of a name that point at a signal group, the first that fits, and the accounts of each group.
SIGNAL_WORDS = {"累计折旧": "accumulated_depreciation", "固定资产原值": "fixed_asset_cost", "坏账准备": "bad_debt", "费用化支出": "rd_expense", "资本化支出": "rd_capital"}
SIGNAL_CODES = {
    "rd_expense": ("6602", "660201", "660202"), "rd_capital": ("1704", "170401"), "accumulated_depreciation": ("1602",), "fixed_asset_cost": ("1601", "160101"),
    "bad_debt": ("1231", "112402", "112403"), "accounts_receivable": ("1122", "112201"), "accounts_payable": ("2202",),
}
CATEGORY_WORDS = (
    ("asset", ("现金", "存款", "应收", "预付", "存货", "固定", "无形", "投资", "货币")),
    ("liability", ("应付", "预收", "借款", "应交", "应付职工")),
    ("equity", ("实收", "资本", "盈余", "本年利润", "利润分配")),
    ("revenue", ("收入", "收益")),
    ("expense", ("费用", "成本", "支出")),
)

# Precedence of candidate sources; a smaller number wins.
SOURCE_PRIORITY = {
    "company_history": 0, "name_exact": 1, "semantic_alias": 2, "name_prefix": 3, "global_history": 4, "code_match": 5, "old_code_crosswalk": 6,
    "parent_inherited_crosswalk": 7, "auxiliary_inherited_parent": 7, "name_anchor": 8, "name_similarity": 9, "code_prefix_parent": 10,
    "code_category_anchor": 11, "code_match_conflict": 12, "history_conflict": 12,
}
SAFE_SCORE = 0.9

# Category of an account by its code; longer prefixes win, contra codes win over all.
CODE_CATEGORIES = {
    "1": "asset", "2": "liability", "3": "equity", "4": "equity", "5": "cost", "6": "revenue_or_expense",
    "6001": "revenue", "6051": "revenue", "6101": "revenue", "6103": "revenue", "6111": "revenue", "6115": "revenue", "6117": "revenue", "6301": "revenue",
    "6401": "expense", "6402": "expense", "6403": "expense", "6601": "expense", "6602": "expense", "660201": "expense", "6603": "expense", "660301": "expense",
    "660302": "revenue", "6701": "revenue", "6702": "revenue", "6711": "expense", "6801": "expense", "6901": "revenue", "6902": "revenue", "690201": "expense",
}
CONTRA_CODES = (
    "112102 112202 112402 112502 122102 1407 142201 146101 1471 147101 150204 151102 151202 152102 152103 153101 153102 1602 1603 160402 160501 161203 161204 "
    "1622 1623 1632 1633 1634 163501 163601 1642 1643 1702 1703 171102 180101 2314 250302 270101 270202 4201 5402"
).split()

# Words and codes of the mismatch audit.
COST_WORDS = ("生产成本", "制造费用", "劳务成本", "营业成本", "销售成本", "主营业务成本")
EQUITY_CODES = ("4001", "4003", "4101", "4103", "4105")
COST_EXPENSE_CODES = ("6401", "6402", "6403")
REVENUE_CODES = ("6001", "6051", "6111", "6301")
AUDIT_RESERVES = ("累计折旧", "累计摊销", "坏账准备", "减值准备", "跌价准备", "资产减值损失")
GROSS_CLIENT_WORDS = ("固定资产", "在建工程", "应收账款", "无形资产", "存货", "管理费用", "销售费用", "制造费用")
GROSS_STANDARD_WORDS = ("固定资产", "在建工程", "应收账款", "无形资产", "存货")
