"""Word lists and thresholds of the scoring operators.

All values in this module are fixed values: results are defined by them.
"""

# --- topics: id, weight, keywords (substrings of the lower-case text) ---
TOPICS = (
    ("data-platform", 1.3, (
        "数据中台", "data platform", "data intelligence", "analytics platform", "data warehouse", "modern data stack", "data infrastructure",
        "data and ai platform", "enterprise data platform", "feature store", "unity catalog", "data control plane", "data observability", "data mesh",
    )),
    ("data-agent", 1.3, (
        "data agent", "data agents", "analytics agent", "agentic analytics", "text-to-sql", "text to sql", "natural language to sql", "genie agent",
        "genie agents", "databricks genie", "data assistant", "data analyst agent", "business intelligence agent", "conversational analytics",
        "conversational data", "governed data agent",
    )),
    ("semantic-layer", 1.2, (
        "semantic layer", "metrics layer", "semantic model", "semantic modeling", "metricflow", "business semantics", "governed metrics",
        "metric definitions", "metrics store", "metric store", "semantic metadata", "ontology", "统一语义",
    )),
    ("intelligent-lakehouse", 1.2, (
        "intelligent data lake", "data lake", "lakehouse", "lakehouse architecture", "data intelligence platform", "delta lake", "apache iceberg",
        "open table format", "medallion architecture", "lakeflow", "智能数据湖",
    )),
    ("rag-eval", 1.1, (
        "rag", "retrieval", "rerank", "rag evaluation", "retrieval evaluation", "eval harness", "retrieval benchmark", "embedding",
        "vector database", "vectorize", "检索", "评测",
    )),
    ("metadata-governance", 1.1, ("metadata", "data governance", "lineage", "catalog", "data catalog", "data quality", "trustworthy ai", "元数据", "数据治理")),
    ("foundation-models", 0.85, (
        "foundation model", "large language model", "llm", "multimodal", "gpt", "claude", "qwen", "deepseek", "open weights", "model release",
        "基础模型", "大模型", "多模态",
    )),
    ("ai-products-agents", 0.9, ("ai product", "ai agent", "agentic", "coding agent", "copilot", "chatgpt", "claude code", "developer platform", "智能体", "AI 产品")),
)
AFFINITY = {
    "data-platform": 1.0, "data-agent": 1.0, "semantic-layer": 1.0, "intelligent-lakehouse": 0.95, "metadata-governance": 0.9, "rag-eval": 0.8,
    "ai-products-agents": 0.75, "foundation-models": 0.45,
}
OTHER_AFFINITY = 0.35
PRIMARY_TOPICS = ("data-platform", "data-agent", "semantic-layer", "intelligent-lakehouse", "metadata-governance")
ACADEMIC_SOURCE = "arxiv-cs-ai"
SOURCE_LIMITS = {ACADEMIC_SOURCE: 6}
IMPACT_BASE = {"official": 0.22, "academic": 0.05, "research_institute": 0.12, "professional_media": 0.12, "independent_author": 0.08}
EVIDENCE_BASE = {"official": 0.50, "academic": 0.35, "research_institute": 0.45, "professional_media": 0.35, "independent_author": 0.25}
CORROBORATED_TYPES = ("professional_media", "independent_author")

# --- patterns ---
ADVANCEMENT = ("we introduce", "we propose", "we present", "new architecture", "new benchmark", "state-of-the-art", "state of the art", "novel method", "首次", "提出")
COMPARISON = ("outperform", "surpass", "improv", "reduc", "increase", "compared with", "baseline", "提升", "降低", "超过")
BENCHMARK = ("benchmark", "evaluation", "evaluated", "experiment", "dataset", "test set", "评测", "数据集")
ARTIFACT = ("open source", "open-source", "github.com", "code:", "release our", "release the code", "apache 2.0", "开源")
ENGINEERING = ("production", "deploy", "integration", "workflow", "runtime", "api", "platform", "pipeline", "inference", "database", "工程", "部署", "工作流")
EFFICIENCY = ("latency", "throughput", "cost", "efficient", "efficiency", "reliability", "scalab", "token", "延迟", "成本", "可靠")
GENERALITY = (
    "general-purpose", "general purpose", "multi-domain", "multiple domains", "across domains", "across models", "across datasets", "across tasks",
    "framework", "platform", "foundation model", "通用", "跨领域",
)
PRODUCT_IMPACT = (
    "product launch", "announcing", "launch", "release", "acquisition", "pricing", "api", "enterprise", "customer", "developer", "workflow",
    "security", "governance", "发布", "企业", "开发者",
)
POLICY_SUBJECT = ("regulation", "regulator", "legislation", "law", "policy", "executive order", "standard", "compliance", "监管", "法规", "法案", "政策", "行政命令", "标准", "合规")
POLICY_ACTION = (
    "takes effect", "effective on", "adopted", "approved", "issued", "signed", "requires", "prohibits", "enforcement", "compliance deadline",
    "生效", "出台", "实施", "通过", "发布", "禁止", "要求", "执法", "合规期限",
)
PRODUCT_RELEASE = (
    "generally available", "general availability", "ga release", "rolled out", "now available", "official release", "launches", "launched",
    "introducing", "debut", "正式发布", "正式上线", "全面开放", "推出", "上线",
)
PRODUCT_SUBJECT = (
    "model", "api", "product", "platform", "service", "feature", "agent", "app", "sdk", "tool", "模型", "接口", "产品", "平台", "服务", "功能", "智能体", "应用",
)
MAJOR_SUBJECT = ("model", "api", "product", "platform", "service", "agent", "模型", "接口", "产品", "平台", "服务", "智能体")
CAPABILITY = (
    "update", "updates", "updated", "upgrade", "upgrades", "upgraded", "enhanced", "enhancement", "enhancements", "native support", "new capability",
    "breaking change", "deprecated", "deprecation", "deprecates", "pricing adjustment", "price change",
    "更新", "升级", "增强", "原生支持", "新增能力", "不兼容变更", "弃用", "价格调整",
)
STRONG_CAPABILITY = (
    "native support", "now supports", "new capability", "breaking change", "deprecated", "deprecation", "deprecates", "pricing adjustment",
    "price change", "原生支持", "新增能力", "不兼容变更", "弃用", "价格调整",
)
BROAD = (
    "app, web, and api", "app, web and api", "all users", "all customers", "developers", "enterprise", "production environments", "open source",
    "open-source", "open weights", "全量用户", "所有用户", "开发者", "企业", "生产环境", "开源",
)
DECISION = (
    "pricing", "price", "api", "breaking change", "deprecated", "deprecation", "deprecates", "migration", "compatibility", "effective on",
    "takes effect", "compliance", "定价", "价格", "接口", "不兼容", "弃用", "迁移", "兼容", "生效", "合规",
)
ADOPTION = (
    "adoption", "adopted by", "active users", "paying users", "customers use", "downloads", "deployments", "usage grew", "usage growth",
    "market share", "widely used", "普及", "采用率", "活跃用户", "付费用户", "客户采用", "下载量", "部署量", "使用量增长", "市场份额", "广泛使用",
)
ADOPTION_SCALE = ("million users", "billion users", "thousand customers", "millions of", "widely used", "百万用户", "千万用户", "亿用户", "数千客户", "广泛使用")
MARKET = (
    "acquisition", "acquisitions", "acquires", "acquired", "merger", "mergers", "funding round", "invests in", "investment in", "investment into",
    "investment of", "strategic investment", "minority investment", "strategic partnership", "收购", "并购", "合并", "融资", "投资", "战略合作",
)
RISK = (
    "security incident", "data breach", "vulnerability", "vulnerabilities", "critical outage", "service outage", "service outages", "product recall",
    "model recall", "device recall", "regulatory investigation", "sanction", "sanctions",
    "安全事件", "数据泄露", "漏洞", "严重故障", "服务中断", "召回", "监管调查", "制裁",
)
NARROW = (
    "modern greek", "wireless propagation", "channel estimation", "beam prediction", "police language", "race and gender", "vr simulations",
    "chiplet", "quantum circuit", "clinical", "heart failure", "heart-failure", "healthcare", "medical",
)
QUANTITATIVE = r"(?i)(?:\b\d+(?:\.\d+)?\s*(?:%|x|ms|million|billion)|\b\d+(?:\.\d+)?\s*s\b|\d+(?:\.\d+)?\s*倍)"
ADOPTION_QUANTITY = (
    r"(?i)(?:\b\d+(?:[,.]\d+)?\s*(?:%|percent|thousand|million|billion|k|m|b)?\s*(?:active users?|paying users?|users?|customers?|downloads?|deployments?|"
    r"adoption(?: rate)?|market share|usage growth)\b|\b(?:active users?|paying users?|customers?|downloads?|deployments?|adoption(?: rate)?|market share|usage)\b"
    r"[^.!?]{0,32}\b\d+(?:[,.]\d+)?|\d+(?:[,.]\d+)?\s*(?:%|万|百万|千万|亿)?\s*(?:活跃用户|付费用户|用户|客户|下载量|部署量|采用率|市场份额|使用量))"
)

# --- labels ---
EVENT_LABELS = {
    "policy_regulation": "监管或政策规则发生实质变化", "product_launch": "新产品或服务进入正式可用阶段", "capability_update": "核心能力、接口或成本条件发生变化",
    "adoption_momentum": "采用与扩散达到显著规模", "technical_breakthrough": "技术突破具有对照或量化证据", "market_structure": "市场结构或关键合作关系发生变化",
    "security_risk": "风险事件可能影响产品或技术决策",
}
NOT_READY = "缺少可展示的中文标题或导读"
GATES = (
    "媒体报道或作者观点不能单独作为 Key Signal", "事件显著性低于 70", "缺少足以改变决策、采用或技术判断的证据", "与 AI、产品或技术决策范围关联不足",
    "发布时间超过 5 天，不进入首页实时 Key Signal", "证据成熟度不足", "学术内容缺少高相关、可泛化的突破证据", "Key Signal 专用得分低于 65",
)

# --- question planning ---
POLICY_QUESTIONS = ("处方", "诊断", "治疗方案", "legal advice", "法律意见", "保证.*股票", "股票.*保证", "保证.*上涨", "guarantee.*stock")
OUTSIDE = ("天气", "下雨", "weather", "世界杯", "比分", "赛季", "sports score")
EXPANSIONS = {
    "价格": "price pricing cost subscription", "订阅": "subscription pricing monthly price", "收购": "acquisition acquire buyer",
    "评测": "evaluation benchmark eval harness", "第三方": "third-party", "网络安全": "cybersecurity cyber evaluation incidents",
    "总体改进": "new safeguards strengthen AI model testing evaluation", "推理": "reasoning inference test-time scaling",
    "运行条件": "protocol reproducibility context window reasoning effort tools", "语义": "semantic layer semantics", "智能体": "agent agentic",
    "agentic harness": "performance efficiency models tasks controlled variables same model same benchmark tool selection MCP servers real-world metrics online experiments",
    "agentic": "agent agentic", "多模态": "multimodal video vision", "安全": "safety guardrail moderation prompt response", "实时": "real-time streaming",
    "数据湖": "data lake lakehouse",
}
COMPARISON_TAILS = ("为什么", "如何", "分别", "共同", "在解决", "解决", "有哪些", "是什么", "有什么")

# --- terminology: source term, preferred form, allowed aliases ---
TERMS = (
    ("Semantic Layer", "语义层", ("统一语义层",)), ("Data Agent", "Data Agent", ("数据智能体", "数据代理")), ("Lakehouse", "湖仓", ("湖仓一体",)),
    ("Retrieval-Augmented Generation", "检索增强生成", ("RAG",)), ("RAG", "RAG", ("检索增强生成",)), ("Rerank", "重排", ("Rerank", "Reranking")),
    ("Grounding", "证据约束", ("事实依据", "Grounding")), ("Metadata", "元数据", ()),
)
