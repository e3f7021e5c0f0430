"""Grounding of questions and claims of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import config
from quarry.functions import text

# Questions that need evidence, and sentences that claim something.
EXCLUDE = r"(?i)^(什麼是|explain|介紹|說明)\s|^how\s+to|^如何|^怎麼|(建議|推薦|最佳實踐)"
NUMERIC = r"(?i)多少|幾[個條筆次]?|幾分鐘|多大|多長|多久|最[大小多少高低]|上限|下限|門檻|閾值|\d+\s*[KMGT]?B?|\d+%|default|預設|預設值|限制[是為]?"
FORCE = ["根據文件", "依文件", "依照規範", "按照手冊", "依據說明", "一定要", "保證正確", "according to", "as per", "specification says"]
SPEC = r"(?i)RFC\s*\d+|ISO\s*\d+|IEEE\s*\d+|API\s*(參數|endpoint|回傳|返回|錯誤碼)|(錯誤|error)\s*(碼|code)|版本\s*(對照|比較|差異|相容)|(行為|behavior)\s*(定義|規範)|(是否|能否|可否)\s*(支[援持]|相容|兼容)"
COMPARE = r"(?i)比較|對照|差異|區別|不同|vs\.?|versus|compared to|哪[個種].*更|選擇.*還是"
CLAIM = r"(?i)\d+|最[大小]|[上下]限|預設|default|must|shall|should|thread-safe|atomic|overflow|underflow"
CODE_CLAIM = r"(?i)函[式數]|變[數量]|class\s|定義在|實[作現]|程式碼|原始碼|source\s*code|呼叫|返回|回傳|參數|傳入|method|function"
REF_CLAIM = r"(?i)根據|依據|文件.*說明|規格.*定義|官方|說明書|手冊|文檔|documentation|spec\b|manual\b"
WHITELIST = r"(?i)^(首先|其次|第[一二三四五]|接下來|最後|總結)|^(以下|如下|包括|例如)|^(根據|依據|參考)|(：|:)\s*$|^(推測|可能|或許)|^[•\-\*]\s"
LEAST_CHARS = 15


def grounding_reason(c: str | Column) -> Column:
    """Why a question needs evidence; '' or 'excluded' if it does not."""
    low = F.lower(F.col(c) if isinstance(c, str) else c)
    numeric = low.rlike(NUMERIC)
    return (
        F.when(low.rlike(EXCLUDE) & ~numeric, "excluded").when(text.contains_any(low, FORCE), "force").when(numeric, "numeric")
        .when(low.rlike(SPEC), "spec").when(low.rlike(COMPARE), "compare").when(text.contains_any(low, config.SPEC_WORDS), "keyword").otherwise("")
    )


def should_refuse(spec: Column, has_ref: Column, top: Column, authoritative: Column) -> Column:
    return spec & (~has_ref | (top < 0.35) | (~authoritative & (top < 0.45)))


def sentences(answers: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, n, sentence): cut after sentence ends, blanks left out."""
    s = answers.select(*key, F.posexplode(F.split(F.regexp_replace(text_col, r"([。.!?！？])\s*", "$1\n"), "\n")).alias("n", "sentence"))
    return s.where(F.trim("sentence") != "")


def claim_coverage(answers: DataFrame, key: list[str], refs: Column, text_col: str = "text") -> DataFrame:
    """(key, claims, verified, coverage): claims name a REF number among refs (array of strings); 1.0 without claims."""
    own = answers.select(*key, F.col(text_col), refs.alias("_refs"))
    s = sentences(own, key, text_col).where(F.col("sentence").rlike(CLAIM))
    named = F.regexp_extract_all("sentence", F.lit(r"(?i)REF\s*(\d+)"), F.lit(1))
    hits = s.join(own.select(*key, "_refs"), key).withColumn("ok", F.arrays_overlap(named, "_refs"))
    counts = hits.groupBy(*key).agg(F.count("*").alias("claims"), F.count(F.when(F.col("ok"), 1)).alias("verified"))
    return own.select(*key).join(counts, key, "left").select(*key, F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("verified", F.lit(0)).alias("verified"), F.round(F.coalesce(F.col("verified") / F.col("claims"), F.lit(1.0)), 6).alias("coverage"))


def claim_counts(answers: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """(key, code_claims, code_cited, ref_claims, ref_cited) over sentences of LEAST_CHARS or more."""
    s = sentences(answers, key, text_col).where(F.length(F.trim("sentence")) >= LEAST_CHARS)
    code, ref, cited = F.col("sentence").rlike(CODE_CLAIM), F.col("sentence").rlike(REF_CLAIM), F.col("sentence").rlike(r"(?i)REF\s*\d+")
    at = F.col("sentence").rlike(r"[\w./]+\.\w+:\d+")
    count = lambda c: F.count(F.when(c, 1))
    return s.groupBy(*key).agg(count(code).alias("code_claims"), count(code & at).alias("code_cited"), count(ref).alias("ref_claims"), count(ref & cited).alias("ref_cited"))


def evidence_only(answers: DataFrame, key: list[str], refs: Column, text_col: str = "text") -> DataFrame:
    """(key, answer, dropped): the answer without claim sentences that name no REF of refs; short and leading ones stay."""
    own = answers.select(*key, F.col(text_col), refs.alias("_refs"))
    s = sentences(own, key, text_col).join(own.select(*key, "_refs"), key)
    t = F.trim("sentence")
    named = F.regexp_extract_all("sentence", F.lit(r"(?i)REF\s*(\d+)"), F.lit(1))
    bad = t.rlike(CLAIM) & (F.length(t) >= LEAST_CHARS) & ~t.rlike(WHITELIST) & ~F.arrays_overlap(named, "_refs")
    rows = s.withColumn("bad", bad)
    kept = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("n", "bad", t.alias("t")))), lambda x: ~x["bad"]), lambda x: x["t"])
    return rows.groupBy(*key).agg(F.array_join(kept, " ").alias("answer"), F.count(F.when(F.col("bad"), 1)).alias("dropped"))
