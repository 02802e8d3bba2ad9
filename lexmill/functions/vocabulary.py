"""Word lists, patterns and texts that results depend on, and small packs for other languages."""

from __future__ import annotations

# Fixed values. Keyword packs of the cleaning rules.
ENTERTAINMENT = (
    "电影", "音乐", "游戏", "天气", "美食", "旅游", "明星", "综艺",
    "电视剧", "歌曲", "演唱会", "综艺节目", "娱乐", "八卦", "热搜",
    "影视", "动漫", "动画", "小说", "漫画", "体育", "运动", "健身",
    "美食推荐", "餐厅", "食谱", "烹饪", "旅行攻略", "景点", "酒店",
    "节假日", "假期", "周末", "聚会", "约会", "聊天", "闲聊", "开玩笑",
    "段子", "笑话", "幽默", "搞笑", "表情包", "梗", "流行语",
)
FACT = (
    "首都", "人口", "面积", "历史年代", "公式", "定理", "周期", "日期",
    "地理位置", "坐标", "经纬度", "海拔", "气候", "温度", "降水量",
    "历史事件", "年份", "朝代", "皇帝", "总统", "领导人", "政治制度",
    "化学元素", "物理常数", "数学常数", "单位换算", "汇率", "时区",
    "节日日期", "纪念日", "生日", "星座", "生肖", "农历", "公历",
    "国家代码", "区号", "邮政编码", "行政区划", "GDP", "经济数据",
    "统计数字", "百分比", "比率", "平均值", "最大值", "最小值",
)
LOW_QUALITY = (
    "我不知道", "我不清楚", "无法回答", "没有信息", "资料不足",
    "请提供更多", "需要更多信息",
    "很抱歉", "对不起", "无法确定", "可能", "也许", "大概", "或许",
    "欢迎咨询", "请咨询", "请联系", "谢谢提问", "感谢咨询",
    "祝您", "再见", "拜拜",
)
TEMPLATES = (
    "这是一个很好的问题", "您问得很好", "这个问题很有趣",
    "根据相关资料", "研究表明", "专家认为",
    "建议您", "您可以", "请尝试", "请注意",
)
LAW_TERMS = ("法律", "法条", "法规", "宪法", "刑法", "民法", "行政法")
TEMPLATE_LEAD = "根据相关法律规定"

# Fixed values. Keyword packs of the ability classes, in the order in which classes are tried.
ABILITIES = {
    "长文本理解": (
        "背景", "事件", "过程", "多轮对话", "上下文", "篇章", "段落", "文章", "文档", "报告", "论文", "故事", "叙述",
        "描述", "详细说明", "全面分析", "整体理解", "全文", "摘要", "总结", "概述", "梗概", "大意", "主旨",
        "中心思想", "结构分析", "逻辑关系", "因果关系", "时间顺序", "空间顺序", "论证过程", "推理链条",
        "证据支持", "论点论据", "文本解读", "语义分析", "情感分析", "意图识别", "信息抽取", "关键信息", "核心内容", "重点部分",
    ),
    "逻辑推理": (
        "为什么", "因为", "所以", "导致", "根据规则", "推理", "推断", "推论", "演绎", "归纳", "类比", "因果",
        "前提", "结论", "假设", "证明", "论证", "理由", "依据", "证据", "逻辑", "必然", "可能", "必然性",
        "可能性", "充分条件", "必要条件", "因果关系", "相关关系", "前提条件", "结论推导", "逻辑链条",
        "推理过程", "思维过程", "分析判断", "评估判断", "决策过程", "问题解决", "策略制定", "方案选择", "最优解", "最优化", "权衡利弊",
    ),
    "结构化表达": (
        "1.", "2.", "首先", "其次", "根据", "第一", "第二", "第三", "第四", "第五", "最后", "综上所述",
        "总而言之", "总的来说", "一方面", "另一方面", "此外", "另外", "同时", "而且", "并且", "然而",
        "但是", "虽然", "尽管", "因此", "于是", "结果", "导致", "造成", "影响", "步骤", "流程", "方法",
        "方式", "途径", "手段", "措施", "方案", "计划", "安排", "顺序", "层次", "级别", "分类", "分组",
        "列表", "表格", "图表", "图示", "框架", "结构", "体系", "系统", "模块", "组件", "部分", "要素", "因素",
    ),
    "歧义消解": (
        "什么意思", "具体", "哪方面", "澄清", "解释", "说明", "定义", "含义", "概念", "术语", "专业名词", "缩写",
        "简称", "全称", "同义词", "近义词", "反义词", "多义词", "歧义", "模糊", "不明确", "不清楚", "不确定", "困惑",
        "疑问", "质疑", "询问", "求证", "确认", "核实", "验证", "辨别", "区分", "分辨", "识别", "判断", "确定", "明确",
        "具体化", "细化", "详细说明", "举例说明", "实例说明", "案例说明", "比喻说明", "类比说明", "对比说明",
    ),
}
ABILITY_SHARES = {"长文本理解": 0.30, "逻辑推理": 0.30, "结构化表达": 0.20, "歧义消解": 0.20}
UNCLASSIFIED = "unclassified"

# Fixed values. Words that mark a refusal, the refusal itself, and texts of the answer step.
REFUSALS = ("无法", "不清楚", "不在", "未检索到", "不构成法律意见", "建议咨询", "无法完整回答", "不在法律知识库")
UNANSWERABLE = "unanswerable"
REFUSAL_ANSWER = "抱歉，根据现有法律知识库，未检索到与您问题相关的法律条文。建议您咨询专业律师获取针对性的法律意见。"
UNKNOWN_LAW = "未知法律"
UNKNOWN_CHUNK_LAW = "未知"
SYSTEM_PROMPT = """你是一个专业的法律咨询助手。请根据以下检索到的法律条文回答用户的问题。

要求：
1. 只根据提供的法律条文回答，不要编造不存在的法条。
2. 如果提供的法律条文不足以回答问题，请明确说明"根据现有法律条文，无法完整回答该问题"。
3. 回答中引用法律条文时，请使用格式：《法律名称》第X条。
4. 回答结构清晰，先给出结论，再列出法律依据。
5. 如果问题涉及的法律领域不在提供的条文中，请说明并建议咨询专业律师。

注意：本回答仅供参考，不构成正式法律意见。"""
USER_PROMPT = ("用户问题：", "\n\n检索到的相关法律条文：\n\n", "\n\n请根据以上法律条文回答用户的问题。回答时请引用具体法律条文作为依据。")
LISTING = ("关于您的问题「", "」，检索到以下相关法律条文：\n", "\n⚠ 本回答仅展示检索到的法律条文，如需综合分析请配置 LLM 模型。")
JUDGE_PROMPT = ("请评判以下回答的质量。\n\n问题：", "\n标准答案：", "\n待评判回答：", "\n\n请只输出一个 0 到 1 之间的数字，表示回答的正确程度：\n- 1.0: 完全正确\n- 0.5: 部分正确\n- 0.0: 完全错误\n\n只输出数字，不要其他内容。")

# Fixed values. Numerals of article numbers and the marks that comparisons leave out.
NUMERALS = r"一二三四五六七八九十百千万零\d"
MARKS = "，。！？；：'（）【】《》、,.!?;:"

#: A small pack for Latin-script texts, for tables without Chinese.
LATIN_ENTERTAINMENT = ("haus", "maison", "ento", "ation")
LATIN_LOW_QUALITY = ("schen", "tionen")

# The prompt of the mode without retrieval, and the texts of samples without an answer.
PLAIN_PROMPT = "你是一个专业的法律咨询助手。请根据你的知识回答问题。本回答仅供参考，不构成正式法律意见。"
NO_MODEL, FAILED = "(无模型可用)", "(错误: {})"

# The texts of the reports.
PROCESSING_COUNTERS = ("original_count", "format_error_count", "rule_filtered_count", "semantic_duplicate_count", "final_count", "train_count", "val_count", "test_count")
PROCESSING_REPORT = """===== 数据处理报告 =====
原始数据数量:      {original_count}
格式错误数量:      {format_error_count}
规则过滤数量:      {rule_filtered_count}
语义重复数量:      {semantic_duplicate_count}
最终保留数量:      {final_count}
训练/验证/测试:    {train_count} / {val_count} / {test_count}
随机种子:          {seed}"""
CATEGORIES, REASONS = "类别分布:", "过滤原因分布:"
EVALUATION_REPORT = """===== 评测报告 =====
实验名称: {experiment_name}
样本数量: {num_samples}"""
METRICS = {
    "retrieval": ("检索效果", (("Recall@1:  ", "recall_at_1", ".4f"), ("Recall@3:  ", "recall_at_3", ".4f"), ("Recall@5:  ", "recall_at_5", ".4f"), ("MRR:       ", "mrr", ".4f"))),
    "citation": ("法条引用", (("Precision:         ", "precision", ".4f"), ("Recall:            ", "recall", ".4f"), ("F1:                ", "f1", ".4f"), ("幻觉率:             ", "hallucination_rate", ".4f"))),
    "answer": ("答案正确性", (("精确匹配率:         ", "exact_match_rate", ".4f"), ("关键词匹配率:       ", "keyword_match_rate", ".4f"), ("结论判定正确率:     ", "conclusion_accuracy", ".4f"), ("LLM Judge 分数:    ", "llm_judge_score", ".4f"))),
    "refusal": ("拒答能力", (("拒答准确率:         ", "refusal_accuracy", ".4f"), ("不可回答问题数:     ", "num_unanswerable", "d"))),
}
BY_CATEGORY, ERRORS, REPORT_NOTE = "  按类别:", "--- 错误案例 ({} 条) ---", "注：本评测结果仅供参考，不构成法律意见。"
COMPARISON_HEADERS = ("实验", "R@1", "R@3", "MRR", "Cite-P", "Cite-R", "Cite-F1", "准确率", "拒答率")
