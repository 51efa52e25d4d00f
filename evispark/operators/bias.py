"""Bias and applicability prompts: a rule is a condition; its label and level are in the lexicon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.functions import text as X

#: Fixed pattern of registrations.
REGISTRY = r"(?i)\b(?:NCT\d{7,8}|ChiCTR[-\w]*|ISRCTN\d+|clinicaltrials\.gov|umin\.ac\.jp|注册号)\b"


def conditions() -> dict[str, Column]:
    """When each of the 32 rules fires, for a profile with ``low``, title and abstract in lower case.

    The wording is read in the abstract also where design, size and effects come
    from a full text. Without an abstract only the first rule fires.
    """
    from evispark.operators import extract

    low, design, n, e = F.col("low"), F.col("design"), F.col("n"), F.col("effects")
    has = lambda k: F.col("cue_" + k) != ""
    trial, synthesis = design.isin(*L.TRIAL), design.isin(*L.SYNTHESIS)
    ci, p = F.size(e["CI"]) > 0, F.size(e["P"]) > 0
    ratio = F.size(F.concat(e["HR"], e["OR"], e["RR"], e["IRR"])) > 0
    known = F.col("plain_polarity") != L.UNCLEAR
    months = F.col("followup")["months"]
    return {
        "no_abstract": F.lit(True), "n_unknown": n.isNull(), "small_n": n < 100, "basic": design == L.BASIC,
        "no_control_case": design == "病例报告 / 病例系列", "causal_claim": design.isin(*L.OBSERVATIONAL) & known & has("causal"),
        "no_control_desc": trial & ~has("control"), "single_arm": has("single_arm"), "retrospective": has("retrospective"),
        "cross_sectional": design == "横断面研究", "no_blinding": trial & ~has("blind"), "self_report": has("self_report"),
        "no_itt": trial & ~has("itt"), "no_power": trial & ~has("power"), "industry_funding": has("industry"),
        "funding_unknown": ~has("industry") & ~has("funding") & ~has("coi"), "posthoc_subgroup": ~synthesis & has("posthoc"),
        "baseline_imbalance": has("imbalance"), "composite_outcome": has("composite"),
        "no_adjustment": design.isin("队列研究", "病例对照研究") & ~has("adjustment"), "high_attrition": extract.attrition(F.col("abstract")) >= 20,
        "pilot": trial & has("pilot"), "no_precision": ~ci & ~p, "no_ci_point": ~ci & ratio, "no_effect_size": known & (F.col("effects_text") == ""),
        "no_registration": trial & ~F.col("abstract").rlike(X.ascii_bounds(REGISTRY)), "no_heterogeneity": (design == "系统评价 / Meta 分析") & ~has("heterogeneity"),
        "single_center": ~synthesis & ~has("multicenter") & has("single_center"), "center_unknown": ~synthesis & ~has("multicenter") & ~has("single_center"),
        "surrogate": F.col("outcome")["label"] == L.SURROGATE_OUTCOME, "followup_unknown": months.isNull(), "short_followup": months < 6,
    }


#: Rules whose evidence is the cue itself.
EVIDENCE = {"basic": "basic", "causal_claim": "causal", "single_arm": "single_arm", "retrospective": "retrospective", "self_report": "self_report", "industry_funding": "industry",
            "posthoc_subgroup": "posthoc", "baseline_imbalance": "imbalance", "composite_outcome": "composite", "pilot": "pilot"}


def with_bias(profiles: DataFrame) -> DataFrame:
    """Adds ``flags`` (level order, then rule order), ``bias_label``, ``bias_brief`` and the applicability columns."""
    from evispark.operators import extract

    low = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit(""))))
    a = profiles.withColumn("low", low).withColumns({f"cue_{k}": X.first_hit(F.col("low"), v) for k, v in L.CUES.items() if k not in ("hard_outcome", "surrogate")})
    a = a.withColumn("plain_polarity", extract.polarity(F.coalesce(F.nullif("conclusion", F.lit("")), F.col("abstract")))["label"])
    blank, when = ~X.filled(F.col("abstract")), conditions()
    rank = {L.FOCUS: 0, L.CHECK: 1, L.INFO: 2}
    flags = []
    for i, (key, label, level) in enumerate(L.FLAGS):
        on = blank if key == "no_abstract" else ~blank & F.coalesce(when[key], F.lit(False))
        proof = F.col("cue_" + EVIDENCE[key]) if key in EVIDENCE else F.col("outcome")["cue"] if key == "surrogate" else F.col("followup")["text"] if key == "short_followup" else F.lit("")
        flags.append(F.when(on, F.struct(F.lit(rank[level]).alias("rank"), F.lit(i).alias("ord"), F.lit(key).alias("key"), F.lit(label).alias("label"), F.lit(level).alias("level"), proof.alias("evidence"))))
    a = a.withColumn("flags", F.array_sort(F.filter(F.array(*flags), lambda f: f.isNotNull())))
    count = lambda lv: F.size(F.filter("flags", lambda f: f["level"] == lv))
    size = F.size("flags")
    a = a.withColumns({
        "focus": count(L.FOCUS),
        "bias_label": F.when(count(L.FOCUS) > 0, F.concat(F.lit("有 "), count(L.FOCUS).cast("string"), F.lit(" 项需重点核对")))
        .when(count(L.CHECK) > 0, F.concat(F.lit("有 "), count(L.CHECK).cast("string"), F.lit(" 项建议核对"))).when(size > 0, "仅信息缺失项").otherwise("未自动发现"),
        "bias_brief": F.when(size == 0, "—").otherwise(F.concat(F.array_join(F.transform(F.slice("flags", 1, 3), lambda f: f["label"]), "、"),
                                                                F.when(size > 3, F.concat(F.lit(" 等 "), size.cast("string"), F.lit(" 项"))).otherwise(""))),
        "setting": F.when(F.col("cue_multicenter") != "", "多中心（摘要自述）").when(F.col("cue_single_center") != "", "单中心（摘要自述）").otherwise("摘要未说明"),
        "availability": F.when(F.col("design") == L.BASIC, "机制 / 动物研究，不直接适用于临床决策").when(F.col("intervention") == "", "摘要未写明具体干预，需回原文核对").otherwise("需核对在你所在机构是否可及、可负担"),
        "followup_flag": F.when(F.col("followup")["months"].isNull(), "未知").when(F.col("followup")["months"] < 6, "偏短").otherwise("")})
    return a.drop("low", "plain_polarity", *[f"cue_{k}" for k in L.CUES if k not in ("hard_outcome", "surrogate")])


def overview(profiles: DataFrame) -> DataFrame:
    """``label, n, docs_with_focus``: flags by frequency."""
    # one pass: an article with a flag in focus adds a row without a label; an outer explode, since a plain one lets the optimizer repeat the whole array in a filter
    named = F.transform("flags", lambda f: F.struct(f["label"].alias("label")))
    mark = F.when(F.col("focus") > 0, F.array(F.struct(F.lit(None).cast("string").alias("label")))).otherwise(F.array().cast("array<struct<label:string>>"))
    n = profiles.select(F.explode_outer(F.concat(named, mark)).alias("f")).where("f is not null").groupBy("f.label").agg(F.count(F.lit(1)).alias("n"))
    # over one row a label
    focus = F.coalesce(F.max(F.when(F.col("label").isNull(), F.col("n"))).over(Window.partitionBy(F.lit(1))), F.lit(0).cast("long"))
    return n.withColumn("docs_with_focus", focus).where("label is not null")
