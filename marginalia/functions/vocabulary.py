"""Word lists, limits and formats whose exact content decides the results."""

# Section keywords, tried group by group in this order.
SECTION_KEYWORDS = [
    ("abstract", ["abstract", "摘要"]),
    ("intro", ["introduction", "intro", "引言", "前言", "背景"]),
    ("method", ["methods", "methodology", "materials and methods", "方法", "材料与方法"]),
    ("result", ["results", "实验结果", "结果"]),
    ("discussion", ["discussion", "讨论"]),
    ("conclusion", ["conclusion", "conclusions", "结论"]),
]

# Chunker defaults, in characters.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
ABSTRACT_FALLBACK_CHARS = 1500
EMBED_MAX_TOKENS = 512

# Technical token pattern of the lexical profiles.
TECHNICAL_TOKEN = r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*%?"

# Characters replaced by a blank before a keyword query is split.
KEYWORD_SPECIAL = r'["*^:()@~<>$\\|+=\[\]{}!?,.;#%&/\-]'

# Chinese domain terms and the English terms they add to a query.
BILINGUAL_TERMS = {
    "多实例学习": ["multiple", "instance", "learning", "mil"],
    "全切片": ["whole", "slide", "image", "wsi"],
    "生存预测": ["survival", "prediction"],
    "交叉验证": ["cross-validation"],
    "外部测试集": ["external", "test", "set"],
    "可解释性": ["interpretability", "interpretable"],
    "消融实验": ["ablation"],
    "原型": ["prototype"],
    "分类": ["classification"],
    "推理": ["inference"],
    "数据集": ["dataset"],
    "准确率": ["accuracy"],
    "阈值": ["threshold"],
    "队列": ["cohort"],
    "病例": ["cases", "patients"],
    "筛选": ["filter", "filtering"],
    "临床": ["clinical"],
    "聚类": ["cluster", "clustering"],
    "跨区域": ["cross-region", "inter-region"],
    "组织": ["tissue"],
    "语义": ["semantic"],
    "模块": ["module"],
    "专家": ["expert"],
    "样本": ["sample"],
    "两阶段": ["two-stage"],
    "训练": ["training"],
    "验证": ["validation"],
    "实验": ["experiment"],
    "表现": ["performance"],
    "指标": ["metric"],
}

# Tag rules: a tag applies when any of its keywords occurs in title, abstract or journal.
TAG_RULES = {
    "深度学习": ["deep learning", "neural network", "dnn"],
    "机器学习": ["machine learning", "classifier", "svm", "random forest"],
    "Transformer": ["transformer", "attention", "bert", "gpt"],
    "卷积神经网络": ["cnn", "convolutional neural network", "resnet", "unet"],
    "计算机视觉": ["computer vision", "image classification", "object detection"],
    "医学影像": ["medical imaging", "radiology", "radiological"],
    "MRI": ["magnetic resonance imaging", " mri ", "mr imaging"],
    "CT": ["computed tomography", " ct ", "ct scan"],
    "病理": ["pathology", "histopathology", "histological"],
    "放射组学": ["radiomics", "radiomic"],
    "T分期": ["t staging", "t stage", "t classification"],
    "结直肠癌": ["colorectal cancer", "rectal cancer", "colon cancer"],
    "预测": ["prediction", "predict", "prognosis"],
    "分割": ["segmentation", "segment"],
    "多模态": ["multimodal", "multi-modal"],
    "预后": ["survival", "prognostic"],
    "临床试验": ["clinical trial", "prospective cohort"],
    "综述": ["review", "survey"],
    "方法学": ["methodology", "framework", "pipeline"],
    "可解释性": ["explainable", "interpretable", "xai"],
}
MAX_TAGS = 5

# Phrases that mark an answer as a refusal.
REFUSAL_PHRASES = ["不知道", "无法回答", "无法确定", "没有相关信息", "未找到", "没有提到", "无法从",
                   "资料中没有", "无法给出"]
# Separators of key points in a reference answer.
KEYPOINT_SEPARATORS = "[、，,；;]"

# Question routing words.
ONLINE_WORDS = ["最新", "最近", "news", "latest", "recent", "2024", "2025", "2026", "搜索", "查一下",
                "网上", "google", "百度", "arxiv"]
EXTERNAL_WORDS = ["arxiv", "论文检索", "最新研究", "未收录", "没有收录", "不在库中"]

# Generated-answer conventions.
GENERATOR_ERROR_PREFIX = "[调用 LLM 出错:"
INSUFFICIENT_NOTICE = "该子问题检索不足。"
NO_HIT_GUARD = "未检索到相关文献片段。必须明确回答「文献库中没有相关内容」，禁止编造任何引用标记。"
NO_CONTEXT_PLACEHOLDER = "（未检索到任何资料）"
UNKNOWN_TITLE = "未知文献"

# Memory types: kept rows per type.
MEMORY_LIMITS = {"short_term": 20, "long_term": 100, "preference": 50, "fact": 200}
LONG_TERM_TYPES = ["long_term", "preference", "fact"]
MEMORY_HEADINGS = {"long": "用户背景与偏好：", "short": "近期讨论主题："}

# Evaluation enumerations.
QUESTION_TYPES = ["comparison", "experiment_data", "factoid", "method_detail", "out_of_scope", "summary"]
GENERATED_TYPES = ["comparison", "experiment_data", "factoid", "method_detail", "summary"]
QA_SOURCES = ["demo_paper", "imported_paper", "synthetic"]
SPLITS = ["dev", "holdout", "train"]

# Retrieval constants.
BM25_K1 = 1.2
BM25_B = 0.9
KEYWORD_B = 0.75
RRF_K = 60
RERANK_POOL = 20
NEIGHBOR_WEIGHT = 0.5
TITLE_MATCH = 0.85
TITLE_MIN_CHARS = 10

# Front-page heuristics.
TITLE_NOISE = [
    "abstract", "introduction", "keywords", "arxiv", "preprint", "journal", "proceedings", "conference",
    "university", "department", "email", "tel:", "fax:", "doi:", "https://", "figure", "table",
    "references", "acknowledgements", "related work", "original article", "article info", "received:",
    "accepted:", "published", "contents lists", "journal homepage", "all rights reserved", "copyright",
    "pattern analysis and applications", "medical image analysis",
]
TITLE_INDICATORS = [
    "with", "for", "of", "and", "based", "via", "using", "towards", "learning", "network", "networks",
    "model", "models", "analysis", "prediction", "segmentation", "classification", "detection", "multi",
    "cross", "hierarchical", "graph", "image", "pathology",
]
TITLE_NEGATIVES = ["we propose", "in this paper", "this study", "existing methods", "recent years",
                   "however", "therefore", "thus", "models often"]
TITLE_BAD_OPENING = r"(?i)^(The|This|These|In|However|Therefore)\b"
AUTHOR_LINE_STOP = (r"@|University|School|Department|Institute|Hospital|Road|China|USA|Ltd\.|Inc\."
                    r"|Received|Accepted|Published|Springer|Elsevier")
AUTHOR_TITLE_WORDS = ["with", "for", "of", "based", "via", "using", "towards", "learning", "network",
                      "networks"]
NON_NAME_PHRASES = ["Multiple Instance", "Whole Slide", "Feature Drowning", "Computational Pathology",
                    "Cancer Genome", "The Cancer", "Graph Convolution", "Hard Example"]
NON_NAME_WORDS = [
    "the", "of", "and", "with", "for", "in", "to", "a", "an", "is", "are", "was", "were", "has", "have",
    "had", "this", "that", "these", "those", "we", "our", "us", "they", "models", "methods", "approach",
    "approaches", "algorithm", "algorithms", "learning", "network", "networks", "data", "images", "image",
    "using", "based", "via", "from", "however", "therefore", "thus", "while", "where", "when", "which",
    "such", "can",
]
ACADEMIC_DOMAINS = [".edu", ".ac.", "university", "institute", "hospital", "lab", "org"]

# Thesis title noise words.
THESIS_TITLE_NOISE = [
    "作者", "学院", "指导教师", "学位论文", "硕士学位", "学士学位", "博士学位", "论文题目", "专业", "学号",
    "答辩日期", "湖州师范学院", "University", "A Dissertation", "Submitted to", "Thesis", "By",
    "Supervisor", "摘要", "本文", "本章", "关键词", "研究方向",
]
CONTENTS_HEADINGS = ["目录", "目  录", "目 录", "Table of Contents", "Contents"]
IGNORED_STYLES = ["toc 1", "toc 2", "toc 3", "toc 4", "toc 5", "toc 6", "toc 7", "toc 8", "toc 9",
                  "table of contents", "header", "footer", "caption", "题注"]

# CSV export: column and header label, in order.
EXPORT_COLUMNS = [("id", "ID"), ("title", "标题"), ("authors", "作者"), ("year", "年份"),
                  ("journal", "期刊/会议"), ("doi", "DOI"), ("status", "阅读状态"), ("tags", "标签"),
                  ("filename", "文件名"), ("created_at", "导入时间")]

# Upload gate.
PDF_MAX_BYTES = 50 * 1024 * 1024
