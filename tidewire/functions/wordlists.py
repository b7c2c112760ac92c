"""Word lists and weights of the news domain. All of them are fixed values and can be replaced by a parameter."""

STRONG = "股票 a股 港股 美股 沪指 深成指 创业板 科创板 北交所 证券 券商 上市公司 财报 业绩 净利润 营收 扣非 公告 回购 增持 减持 分红 并购 收购 重组 定增 募资 融资 ipo 市值 估值 股价 涨停 跌停 龙虎榜 停牌 复牌".split()
WEAK = "银行 白酒 新能源 电池 锂电 光伏 半导体 芯片 算力 人工智能 ai 医药 创新药 军工 地产 汽车 储能 煤炭 钢铁 家电 消费电子 机器人 稀土 黄金 原油 期货 基金 信托 保险".split()
EXCLUDE = "nba cba 世界杯 欧冠 英超 足球 篮球 羽毛球 网球 比赛 电影 电视剧 综艺 明星 演员 歌手 演唱会 高考 中考 旅游 景区 航班 酒店 美食 游戏 动漫".split()
STRICT_EXCLUDE = "税务局 省委 省政府 政协 人大 乡村振兴 现场观摩 主题教育 工作会议 文旅 景区".split()
COMPANY = "公司 企业 集团 股份 有限合伙 上市 板块 龙头 行情 投资者 机构 资本市场 市值 证券时报 财联社".split()

#: Event types, in the order in which they are tried, with the words that show them.
EVENTS = {
    "业绩": "业绩 净利润 营收 预增 亏损 财报 盈利".split(),
    "经营": "经营 订单 产能 扩产 合作 中标 签约".split(),
    "投融资": "融资 投资 增持 减持 收购 并购 回购".split(),
    "政策": "政策 央行 降准 逆回购 监管 指导意见".split(),
    "风险": "风险 处罚 调查 诉讼 违约 暴跌 下滑 承压".split(),
    "市场舆情": "市场 舆情 热议 关注 波动 情绪".split(),
    "产品": "产品 发布 新品 技术 电池 芯片".split(),
}
OTHER_EVENT = "其他"
EVENT_WEIGHTS = {"业绩": 1.15, "经营": 1.0, "投融资": 1.05, "政策": 1.05, "风险": 1.15, "市场舆情": 0.95, "产品": 1.0, "其他": 0.9}
OTHER_WEIGHT = 0.9
EVENT_FACTORS = {"业绩": "earnings", "经营": "operations", "投融资": "financing", "市场舆情": "market_buzz", "风险": "risk"}

POSITIVE = "增长 提升 改善 中标 签约 获批 回暖 突破 定点 创新高 恢复".split()
NEGATIVE = "下滑 亏损 处罚 调查 风险 承压 违约 诉讼 减值 下跌 波动".split()
RISK = "风险 处罚 调查 诉讼 违约 承压 下滑 亏损".split()
TREND_UP = "继续 进一步 加速 改善 恢复 增长 回暖".split()
TREND_DOWN = "承压 下滑 走弱 恶化 波动 风险".split()

STUDY_FINANCE = "股票 a股 港股 美股 沪指 深成指 创业板 公告 财报 业绩 营收 净利润 归母净利润 扣非 市值 股价 估值 分红 回购 增持 减持 融资 收购 并购 订单 销量 产能 产品 渠道 经销商 合作".split()
STUDY_NEGATIVE = "政府 市委 省政府 人大 政协 招商 签约 大会 论坛 发布会 开幕式 文旅 旅游 景区 世界杯 比赛 体育 铁人三项 乡村振兴 考察 观摩 推介会".split()
STUDY_POSITIVE_BY_STOCK = {
    "宁德时代": "宁德时代 宁王 catl 动力电池 电池 储能 锂电 碳酸锂 电芯 麒麟电池 钠离子 新能源车 新能源汽车 车企 磷酸铁锂".split(),
    "贵州茅台": "贵州茅台 茅台 飞天茅台 白酒 酱香 酒企 高端白酒 批价 动销 终端价 经销商 渠道 酒业 直营".split(),
}
STUDY_NEGATIVE_BY_STOCK = {"宁德时代": "招商引资 项目签约 集中签约 产业园 开工仪式".split(), "贵州茅台": "敷在脸上的茅台 xx界茅台 赛道茅台 旅游 景区".split()}

QUARTER_FINANCE = "股票 a股 港股 美股 公告 财报 业绩 营收 净利润 市值 股价 估值 分红 回购 增持 减持 融资 收购 并购 订单 销量 产能 产品 渠道 经销商 合作".split()
QUARTER_NOISE = "政府 市委 省政府 人大 政协 招商 大会 论坛 发布会 开幕式 文旅 旅游 景区 世界杯 比赛 体育 乡村振兴 考察 观摩 推介会".split()
AMBIGUOUS = "平安 中信 伊利 美的 三一 海康 神华 中芯 紫金 恒瑞 招行 工行".split()
