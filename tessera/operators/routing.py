"""Question routing: what kind of question it is, how it is to be answered, and the sub-queries that it is cut into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of question in order of priority, each with its reason, the words that mark it, and ideographs that do.
MARKERS = {
    "systematic_review": (
        "systematic_review_marker",
        ["systematic review", "meta analysis", "meta-analysis", "metaanalysis", "evidence synthesis", "prisma", "all studies", "comprehensive review"],
        ["系统综述", "荟萃分析", "meta分析", "证据综合", "prisma", "所有研究", "全面综述"],
    ),
    "latest_progress": ("recency_marker", ["latest", "recent", "current state", "state of the art", "emerging", "new advance", "new advances"], ["最新", "近期", "当前进展", "研究前沿", "新进展", "截至目前"]),
    "pico": (
        "clinical_pico_marker",
        ["patient", "patients", "participant", "participants", "population", "intervention", "comparator", "outcome", "clinical", "randomised", "randomized", "placebo", "treatment"],
        ["患者", "人群", "干预", "对照", "结局", "临床", "随机", "安慰剂", "疗效", "不良反应"],
    ),
    "comparison": ("comparison_marker", ["versus", "vs", "compared with", "comparison", "difference between"], ["比较", "对比", "优于", "劣于", "差异", "哪种更"]),
    "mechanism": ("mechanism_marker", ["mechanism", "pathway", "mediate", "mediates", "mediated", "causal", "cause", "why", "how does"], ["机制", "通路", "因果", "导致", "为何", "为什么", "如何作用"]),
    "methodology": (
        "methodology_marker",
        ["method", "methodology", "protocol", "assay", "workflow", "benchmark", "evaluation metric", "sample size", "statistical method"],
        ["方法学", "实验方法", "方案", "流程", "检测方法", "评价指标", "样本量", "统计方法", "质控"],
    ),
}
#: Years that mark recent work, as patterns over lower case.
YEARS = ["\\bpast (three|five|ten|[0-9]+) years?\\b", "近[三五十0-9]+年"]
#: What a kind's further searches look at, and the words that they add.
ASPECTS = {
    "comparison": {"comparative_effectiveness": "comparative effectiveness", "comparative_safety": "safety adverse events"},
    "pico": {"population_intervention": "population intervention", "comparator_outcomes": "comparator outcomes", "study_design": "randomized controlled trial"},
    "systematic_review": {"primary_studies": "primary study", "systematic_reviews": "systematic review meta analysis", "citation_landscape": "references cited by citation network", "bias_heterogeneity": "risk of bias heterogeneity"},
    "latest_progress": {"recent_primary": "recent primary research", "recent_reviews": "recent review", "citation_landscape": "citation network emerging papers", "open_questions": "limitations research gaps"},
    "mechanism": {"pathway": "molecular pathway", "causal_evidence": "causal evidence perturbation", "alternative_mechanisms": "alternative mechanism"},
    "methodology": {"validation": "validation benchmark", "bias_reproducibility": "bias reproducibility quality control"},
}
#: Kinds that are researched in depth or in parts, the length from which a mechanism is, words that part clauses, and limits.
DEEP, IN_PARTS, LONG, PARTING = ["systematic_review", "latest_progress"], ["comparison", "pico"], 180, ["and", "versus", "vs", "vs.", "以及", "并且"]
LEAST_CLAUSE, MOST_SUBQUERIES = 8, 6
FIRST, STEP, TOP, NONE = 0.72, 0.08, 0.97, 0.55


def marked(text: Column, kind: str) -> Column:
    """Whether a word of the kind stands in the text."""
    low = F.lower(text)
    _, words, ideographs = MARKERS[kind]
    found = low.rlike("\\b(" + "|".join(words) + ")\\b")
    for part in ideographs:
        found = found | F.contains(low, F.lit(part))
    for years in YEARS if kind == "latest_progress" else []:
        found = found | low.rlike(years)
    return found


def routed(questions: DataFrame, text: str, identifier: str | None = None, preference: str = "auto") -> DataFrame:
    """Adds question_type, confidence, reasons and strategy.

    The type is the first in MARKERS of those that match, ``general`` without
    any, ``identifier`` where the column ``identifier`` is true; confidence
    grows with the number of matches. The strategy is the preferred one, else it
    follows from the type. A null text is general.
    """
    question = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    hits = {k: marked(question, k) for k in MARKERS}
    n = sum((h.cast("int") for h in hits.values()), F.lit(0))
    kind = F.coalesce(*[F.when(h, F.lit(k)) for k, h in hits.items()], F.lit("general"))
    reasons = F.array_compact(F.array(*[F.when(h, F.lit(MARKERS[k][0])) for k, h in hits.items()]))
    reasons = F.when(n == 0, F.array(F.lit("no_specialized_marker"))).otherwise(reasons)
    confidence = F.when(n == 0, F.lit(NONE)).otherwise(F.least(F.lit(TOP), FIRST + STEP * n))
    known = F.coalesce(F.col(identifier), F.lit(False)) if identifier else F.lit(False)
    kind = F.when(known, "identifier").otherwise(kind)
    automatic = F.when(kind.isin(DEEP), "deep_research").when(kind.isin(IN_PARTS) | ((kind == "mechanism") & (hits["comparison"] | (F.length(question) > LONG))), "decomposition").otherwise("direct")
    strategy = F.when(known, "direct").otherwise(automatic if preference == "auto" else F.lit(preference))
    return questions.withColumn("question_type", kind).withColumn("confidence", F.when(known, 1.0).otherwise(confidence)).withColumn("reasons", F.when(known, F.array(F.lit("exact_identifier"))).otherwise(reasons)).withColumn("strategy", strategy)


def subqueries(routes: DataFrame, text: str, most: int = 4) -> DataFrame:
    """The rows of ``routed`` with (place, focus, query), a row for each sub-query, ``most`` at most and never over MOST_SUBQUERIES.

    A direct question is its own only one. Others begin with the question, go
    on with the aspects of their type and end with their clauses of over
    LEAST_CLAUSE characters, each query once whatever its case.
    """
    question = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))
    pair = lambda focus, query: F.struct(F.lit(focus).alias("focus"), query.alias("query"))
    none = F.array().cast("array<struct<focus:string,query:string>>")
    aspects = none
    for kind, parts in ASPECTS.items():
        aspects = F.when(F.col("question_type") == kind, F.array(*[pair(f, F.concat(question, F.lit(" "), F.lit(w))) for f, w in parts.items()])).otherwise(aspects)
    words = "|".join(w.replace(".", "[.]") for w in PARTING)
    parts = F.split(question, f"(?i)[;；。!?！？]\\s*|\\s+({words})\\s+")
    clauses = F.transform(F.filter(F.transform(parts, lambda c: F.trim(c, F.lit(" ,，"))), lambda c: F.length(c) > LEAST_CLAUSE), lambda c: F.struct(F.lit("clause").alias("focus"), c.alias("query")))
    every = F.concat(F.array(pair("core", question)), aspects, F.when(F.size(parts) > 1, clauses).otherwise(none))
    low = F.transform(every, lambda x: F.lower(x["query"]))
    once = F.slice(F.filter(every, lambda x, i: F.array_position(low, F.lower(x["query"])) == i + 1), 1, max(1, min(most, MOST_SUBQUERIES)))
    rows = F.when((F.col("strategy") == "direct") | F.lit(most <= 1), F.array(pair("original", question))).otherwise(once)
    return routes.select("*", F.posexplode(rows).alias("place", "_q")).select(*routes.columns, (F.col("place") + 1).alias("place"), F.col("_q.focus").alias("focus"), F.col("_q.query").alias("query"))


def followups(question: Column, gaps: Column, existing: Column, limit: int = 2) -> Column:
    """Up to two queries for gaps of three characters or more, each once and none that exists."""
    cleaned = F.filter(F.transform(gaps, lambda g: F.trim(F.regexp_replace(g, r"\s+", " "))), lambda g: F.length(g) >= 3)
    new = F.transform(cleaned, lambda g: F.concat(question, F.lit(" evidence gap "), F.left(g, F.lit(240))))
    known = F.transform(existing, lambda q: F.lower(F.trim(F.regexp_replace(q, r"\s+", " "))))
    low = F.transform(new, F.lower)
    return F.slice(F.filter(new, lambda q, i: (F.array_position(low, F.lower(q)) == i + 1) & ~F.array_contains(known, F.lower(q))), 1, max(0, min(limit, 2)))


def merged(hits: DataFrame, item: str, limit: int) -> DataFrame:
    """Results of sub-queries as one: per question and item the best score and how many sub-queries hit it, 3 x limit at most."""
    from pyspark.sql import Window

    best = hits.groupBy("query_id", item).agg(F.max("score").alias("score"), F.count("*").alias("hits"))
    by = Window.partitionBy("query_id").orderBy(F.desc("hits"), F.desc("score"), item)
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= 3 * limit)
