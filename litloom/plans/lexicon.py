"""Words that plans of questions look for. All tables here are fixed values."""

from __future__ import annotations

ENGLISH_STOPWORDS = (
    "about", "after", "among", "and", "are", "before", "between", "does", "effect", "effects", "for", "from", "how", "into", "paper", "papers", "research",
    "study", "the", "their", "using", "what", "when", "where", "which", "with",
)

CHINESE_FUNCTION_WORDS = (
    "近年来", "近几年", "请问", "如何", "是否", "什么", "哪些", "为什么", "以及", "及其", "中的", "用于", "对于", "关于", "研究", "影响",
)

CHINESE_TERMS = (
    ("人工智能", "artificial intelligence"), ("机器学习", "machine learning"), ("深度学习", "deep learning"), ("神经网络", "neural network"),
    ("大语言模型", "large language model"), ("生物医学", "biomedicine"), ("生命科学", "life science"), ("帕金森病", "Parkinson disease"),
    ("阿尔茨海默病", "Alzheimer disease"), ("心血管", "cardiovascular"), ("临床试验", "clinical trial"), ("随机对照试验", "randomized controlled trial"),
    ("系统综述", "systematic review"), ("荟萃分析", "meta-analysis"), ("石墨烯", "graphene"), ("二维材料", "two-dimensional materials"),
    ("柔性传感器", "flexible sensor"), ("传感器", "sensor"), ("步态监测", "gait monitoring"), ("癌症", "cancer"), ("肿瘤", "tumor"), ("诊断", "diagnosis"),
    ("治疗", "treatment"), ("预后", "prognosis"), ("预测", "prediction"), ("筛查", "screening"), ("机制", "mechanism"), ("方法", "method"), ("模型", "model"),
    ("蛋白质", "protein"), ("基因", "gene"), ("基因组", "genome"), ("药物", "drug"), ("材料", "materials"), ("电池", "battery"), ("能源", "energy"),
    ("环境", "environment"), ("气候", "climate"), ("综述", "review"), ("最新", "recent"), ("近期", "recent"), ("矛盾证据", "contradictory evidence"),
)

CATEGORIES = {
    "methods": (
        "assay", "benchmark", "cohort", "deep learning", "machine learning", "meta-analysis", "microscopy", "randomized", "regression", "sequencing", "simulation",
        "systematic review", "transformer", "方法", "模型", "测量", "实验", "临床试验", "随机对照", "系统综述", "荟萃分析",
    ),
    "materials_objects": (
        "battery", "cell", "cohort", "graphene", "material", "patient", "polymer", "protein", "sensor", "tissue", "tumor", "石墨烯", "二维材料", "材料", "患者",
        "细胞", "蛋白质", "传感器", "肿瘤", "电池",
    ),
    "tasks": (
        "classification", "detection", "diagnosis", "forecasting", "generation", "monitoring", "prediction", "screening", "诊断", "检测", "分类", "监测", "生成",
        "筛查", "预测",
    ),
    "outcomes": (
        "accuracy", "adverse", "efficacy", "mortality", "outcome", "performance", "prognosis", "safety", "survival", "不良反应", "安全性", "疗效", "生存", "性能",
        "预后", "准确率", "结局",
    ),
}

BIOMEDICAL = (
    "alzheimer", "biomedical", "cancer", "cardiovascular", "cell", "clinical", "disease", "drug", "gene", "genome", "health", "medicine", "patient", "parkinson",
    "protein", "therapy", "tumor", "临床", "医学", "帕金森病", "患者", "疾病", "癌症", "细胞", "肿瘤", "药物", "蛋白质", "诊断", "治疗",
)

INTENTS = {
    "recent": ("latest", "newest", "recent", "近年", "近期", "最新"),
    "review": ("evidence synthesis", "meta-analysis", "review", "systematic review", "综述", "荟萃分析", "系统评价", "系统综述"),
    "seminal": ("classic", "foundational", "landmark", "seminal", "奠基", "经典", "里程碑"),
    "methods": ("benchmark", "method", "methodology", "protocol", "validation", "方法", "方案", "验证"),
    "contradictory-evidence": ("conflicting", "contradictory", "negative result", "null result", "replication", "不一致", "否定结果", "矛盾", "重复验证"),
}

#: Providers in the order in which a kind of question asks them.
ROUTES = {
    "identifier": ("crossref", "openalex", "semantic_scholar", "europe_pmc"),
    "biomedical": ("europe_pmc", "openalex", "crossref", "semantic_scholar"),
    "general": ("openalex", "crossref", "semantic_scholar", "europe_pmc"),
}

#: Requests of a question in all, and of each provider.
REQUEST_LIMIT = 12
PROVIDER_BUDGETS = {"openalex": 4, "crossref": 3, "semantic_scholar": 2, "europe_pmc": 3}
MAX_ENGLISH_LENGTH, MAX_VARIANTS = 512, 6
