"""Thresholds, weights and budgets with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_floor: float = 0.05
    expansion_weight: float = 0.9
    candidate_k: int = 30
    threshold: float = 0.30
    threshold_short: float = 0.25
    threshold_strict: float = 0.40
    mmr_lambda: float = 0.7
    margin: float = 0.05
    weak_top: float = 0.40
    expand_below: float = 0.45
    skip_rerank: float = 0.55
    pollution_variance: float = 0.02
    merge_chars: int = 2500
    dedup_jaccard: float = 0.85
    batch_items: int = 32
    batch_chars: int = 20_000
    grep_line_chars: int = 500
    grep_total_chars: int = 200_000
    chars_per_token: float = 3.5
    reserve_tokens: int = 4096
    soft_limit: float = 0.80
    hard_limit: float = 0.90
    max_hops: int = 4
    max_paths: int = 3
    node_limit: int = 50
    diversity_penalty: int = 12
    recent_tool_outputs: int = 4
    # Rank weights by document type.
    source_weights: dict = field(default_factory=lambda: {
        "spec": 1.3, "api": 1.25, "manual": 1.2, "warning": 1.15, "guide": 1.0, "faq": 1.0, "doc": 1.0, "web": 0.85, "diagram": 0.8, "chat": 0.75,
    })
    # Chunk size and overlap by document type.
    chunk_settings: dict = field(default_factory=lambda: {
        "spec": (800, 150), "api": (600, 100), "manual": (1000, 200), "guide": (1200, 200), "faq": (800, 100), "default": (1200, 200),
    })


DEFAULT = Settings()

# Words that retrieval passes over.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need to of in for on "
    "with at by from as into through during before after above below between under again then once here there when where why how all each few "
    "more most other some such no nor not only own same so than too very just and but if or because until while this that these those what "
    "的 是 在 有 和 與 了 我 你 他 她 它 們 這 那 要 會 能 可以 一個 什麼 怎麼 如何"
).split()
# Words that code search passes over.
CODE_STOPWORDS = (
    "the and for this that with from are was how why what where when which can could should would will have has had does did not but use "
    "using used function class method 這個 那個 如何 為什麼 什麼 怎麼"
).split()
# File name parts that tell a document's type, first match wins.
TYPE_BY_NAME = {
    "spec": ["_spec", "spec_", "specification", "_datasheet", "datasheet_"],
    "guide": ["_guide", "guide_", "tutorial", "howto", "how_to", "quickstart"],
    "faq": ["faq", "_qa", "q&a", "questions"],
    "api": ["_api", "api_", "reference", "_ref"],
    "manual": ["manual", "_manual", "handbook"],
}
# Patterns that tell a document's type by its first 2000 characters.
TYPE_BY_CONTENT = {
    "spec": [r"(?i)specification", r"(?i)electrical\s+characteristics", r"(?i)absolute\s+maximum\s+ratings", r"(?i)timing\s+diagram", r"(?i)pin\s+configuration", r"(?i)register\s+map", r"(?i)typical\s+application"],
    "api": [r"(?i)api\s+reference", r"(?i)endpoint[s]?\s*:", r"(?i)request\s+body", r"(?i)response\s+format", r"(?i)parameters?\s*:", r"(?i)returns?\s*:", r"def\s+\w+\s*\(", r"function\s+\w+\s*\("],
    "guide": [r"(?i)getting\s+started", r"(?i)step\s+\d+", r"(?i)tutorial", r"(?i)example[s]?\s*:", r"(?i)how\s+to", r"(?i)quick\s*start"],
    "faq": [r"(?i)frequently\s+asked", r"(?i)Q\s*:\s*", r"(?i)A\s*:\s*", r"(?i)問\s*[:：]", r"(?i)答\s*[:：]"],
    "manual": [r"(?i)user\s+manual", r"(?i)操作\s*手冊", r"(?i)使用\s*說明", r"(?i)installation\s+guide", r"(?i)configuration"],
}
# Words that make a chunk a warning.
WARNINGS = ["WARNING", "CAUTION", "DANGER", "NOTE:", "IMPORTANT:", "警告", "注意", "危險", "請勿", "禁止", "不可", "切勿", "必須", "MUST NOT", "DO NOT", "NEVER", "限制"]
# What marks a question for numbers, and question classes in order.
NUMERIC_QUESTION = r"(?i)\d+|最[大小]|[上下]限|預設|default|多少|幾[個條筆次]"
QUESTION_CLASSES = {
    "spec": ["規格", "spec", "manual", "datasheet", "資料手冊", "限制", "最大值", "最小值", "上限", "下限"],
    "bug": ["bug", "錯誤", "error", "crash", "fail", "修", "fix", "問題", "issue", "不work", "不能", "exception"],
    "code": ["在哪", "定義", "實作", "實現", "怎麼", "如何", "where", "how", "implement", "function", "class"],
}
SPEC_WORDS = ["規格", "spec", "manual", "datasheet", "資料手冊", "限制", "最大值", "最小值", "thread-safe", "overflow", "兼容", "相容", "行為定義", "behavior", "是否支援", "是否支持", "上限", "下限", "邊界", "boundary", "合規", "compliance"]
