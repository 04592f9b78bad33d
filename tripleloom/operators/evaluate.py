"""Scoring against gold data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .vocab import reduction


def token_f1(pairs: DataFrame, keys: list[str], pred: str, gold: str) -> DataFrame:
    """(keys, f1) of normalised texts: multiset overlap of tokens; two empty texts agree."""

    def tokens(name: str) -> Column:
        return F.filter(F.split(F.col(name), " "), lambda t: t != "")

    sized = pairs.select(*keys, F.size(tokens(pred)).alias("np"), F.size(tokens(gold)).alias("ng"), tokens(pred).alias("tp"), tokens(gold).alias("tg"))
    one = sized.select(*keys, F.explode("tp").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("a"))
    two = sized.select(*keys, F.explode("tg").alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("b"))
    common = one.join(two, [*keys, "token"]).groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("common"))
    found = sized.select(*keys, "np", "ng").join(common, keys, "left")
    both = F.col("np") + F.col("ng")
    f1 = F.when((F.col("np") == 0) | (F.col("ng") == 0), F.when(both == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(2.0 * F.col("common") / both, F.lit(0.0)))
    return found.select(*keys, f1.alias("f1"))


def best_over_references(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, em, f1): any exact match and the best F1 over a question's references."""
    return scores.groupBy(*keys).agg(F.bool_or("exact").alias("em"), F.max("f1").alias("f1"))


def sentence_buckets(resolved: DataFrame) -> DataFrame:
    """(sample_id, triples in order, dropped): resolved rows gathered by sentence."""
    done = F.col("reason").isNull()
    entry = F.struct("kind", "ord", "subject", "relation", "object")
    return resolved.groupBy("sample_id").agg(
        F.count_if(done).alias("kept"), F.count_if(~done).alias("dropped"), F.array_sort(F.collect_list(F.when(done, entry))).alias("triples")
    )


def judgment_counts() -> list[Column]:
    """Aggregates over gold rows (matched, failed, direction, extra)."""
    matched, failed = F.count_if("matched"), F.count_if("failed")
    judged = F.count("*") - failed
    return [
        F.count("*").alias("gold"), matched.alias("matched"), failed.alias("failed"),
        F.round(F.when(judged > 0, matched / judged), 6).alias("recall"),
        F.count_if(F.col("matched") & (F.col("direction") == "same")).alias("same"), F.count_if(F.col("matched") & (F.col("direction") == "inverse")).alias("inverse"),
    ]


def overall_and_by(judged: DataFrame, domain: str) -> DataFrame:
    """The same summary over all rows (domain null) and for each domain."""
    return judged.groupingSets([[], [domain]], domain).agg(*judgment_counts())


def groundedness_filter(gold: DataFrame, flags: DataFrame, key: str, triples: str, items: str) -> DataFrame:
    """Drop gold triples flagged ungrounded; where counts differ or flags are missing, all stay."""
    both = gold.join(flags, key, "left")
    same = F.size(triples) == F.size(F.coalesce(F.col(items), F.array()))
    keep = F.filter(F.col(triples), lambda x, i: F.coalesce(F.get(F.col(items), i), F.lit(True)))
    return both.withColumn(triples, F.when(same, keep).otherwise(F.col(triples))).drop(items)


def binary_accuracy(judgments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scored, failed, accuracy): failures are never scored; all failed gives null."""
    return judgments.groupBy(*keys).agg(F.count("evaluation").alias("scored"), F.count_if(F.col("evaluation").isNull()).alias("failed"), F.round(F.avg("evaluation"), 6).alias("accuracy"))


def qa_summary(answers: DataFrame) -> DataFrame:
    return answers.agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("em").cast("int")), 6).alias("em"), F.round(F.avg("f1"), 6).alias("f1"),
        F.count_if("no_graph").alias("no_graph"), F.count_if("no_entity").alias("no_entity"),
    )


def compare_reports(left: DataFrame, right: DataFrame, key: str, metric: str) -> DataFrame:
    """Full outer view of one metric of two reports."""
    return left.select(key, F.col(metric).alias("left")).join(right.select(key, F.col(metric).alias("right")), key, "full_outer")


def report_table(summaries: DataFrame, metrics: list[str], by: str) -> DataFrame:
    """One row for each report of (report, metric, value), with the named metrics, best ``by`` first; a missing one counts as 0 there."""
    found = summaries.groupBy("report").pivot("metric", metrics).agg(F.first("value"))
    return found.orderBy(F.desc(F.coalesce(F.col(by), F.lit(0.0))), "report")


def metric_rows(sections: dict[str, DataFrame | None]) -> DataFrame | None:
    """(section, metric, value) of sections that are each one row of numbers; absent sections are left out."""
    out = None
    for name, row in sections.items():
        if row is None:
            continue
        cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in row.columns])
        part = row.select(F.lit(name).alias("section"), F.explode(cells).alias("x")).select("section", "x.metric", "x.value")
        out = part if out is None else out.unionAll(part)
    return out


def vocabulary_section(items: DataFrame, n_raw: DataFrame) -> DataFrame:
    """One row about a vocabulary: num_raw, num_canonical, reduction_pct, never_merged_share.

    ``items`` has surface_forms; ``n_raw`` is one row with num_raw.
    """
    n = items.agg(F.count("*").alias("num_canonical"), F.count_if(F.size("surface_forms") <= 1).alias("alone"))
    one = n.join(F.broadcast(n_raw.select("num_raw")))
    share = F.when(F.col("num_canonical") > 0, F.col("alone") / F.col("num_canonical"))
    percent = F.round(reduction(F.col("num_raw"), F.col("num_canonical")), 2)
    return one.select("num_raw", "num_canonical", percent.alias("reduction_pct"), F.round(share, 4).alias("never_merged_share"))


def stratified_sample(items: DataFrame, stratum: str, order: Column, n: int) -> DataFrame:
    """n rows of each stratum, those that come first by ``order`` (a hash of the seed and the id)."""
    return items.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum).orderBy(order))).filter(F.col("_rn") <= n).drop("_rn")


def select_judged_types(judged: DataFrame) -> DataFrame:
    """Swap our sides where the match was inverse (domain, range, direction)."""
    turned = F.col("direction") == "inverse"
    return judged.withColumns({"domain": F.when(turned, F.col("range")).otherwise(F.col("domain")), "range": F.when(turned, F.col("domain")).otherwise(F.col("range"))})


#: What a judge may say of two types, and what else is counted.
TYPE_LABELS = ("exact", "more_general", "more_narrow", "not_related")
OTHER_LABELS = ("no_gold_type", "judge_call_failed")


def full_summary(gold: DataFrame, sentences: DataFrame, by: str | None = None) -> DataFrame:
    """All counts over gold rows and sentences; with ``by`` also for each of its values (null: all).

    ``gold`` has matched, failed, direction, strength (null: no constraint) and
    containment_ok; ``sentences`` has generated, extras and call_failures.
    """
    keys = [by] if by else []
    side = gold.select(*keys, F.lit(True).alias("is_gold"), "matched", "failed", "direction", "strength", "containment_ok")
    both = side.unionByName(sentences.select(*keys, "generated", "extras", "call_failures"), allowMissingColumns=True)
    matched, held = F.col("matched"), F.col("matched") & F.col("strength").isNotNull()
    total, failed = F.count("is_gold"), F.count_if(~matched & F.col("failed"))
    generated, extras = (F.coalesce(F.sum(n), F.lit(0)) for n in ("generated", "extras"))
    counts = [
        total.alias("gold"), generated.alias("generated"), F.coalesce(F.sum("call_failures"), F.lit(0)).alias("call_failures"),
        F.round(F.when(total > failed, F.count_if(matched) / (total - failed)), 6).alias("recall"),
        F.count_if(matched & (F.col("direction") == "same")).alias("same"), F.count_if(matched & (F.col("direction") == "inverse")).alias("inverse"),
        F.count_if(~matched & ~F.col("failed")).alias("missed"), failed.alias("failed"),
        extras.alias("extras"), F.round(F.when(generated > 0, extras / generated), 6).alias("extra_rate"),
        F.count_if(held).alias("with_constraint"), F.count_if(matched & F.col("strength").isNull()).alias("without_constraint"),
        F.count_if(held & (F.col("containment_ok") == F.lit(False))).alias("containment_violations"),
    ]
    return both.groupingSets([[], [by]], by).agg(*counts) if by else both.agg(*counts)


def label_distribution(gold: DataFrame, label: str, failed: str) -> DataFrame:
    """(label, n) over matched gold rows, every label present; an unknown or missing one counts as no_gold_type."""
    known = F.col(label).isin(*TYPE_LABELS)
    named = F.when(F.coalesce(F.col(failed), F.lit(False)), "judge_call_failed").when(known, F.col(label)).otherwise("no_gold_type")
    counted = gold.filter("matched").groupBy(named.alias("label")).agg(F.count("*").alias("n"))
    every = gold.sparkSession.sql("SELECT explode(array({})) AS label".format(", ".join(f"'{x}'" for x in TYPE_LABELS + OTHER_LABELS)))
    return every.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def tier_counts(gold: DataFrame) -> DataFrame:
    """(strength, n) of the constraints that matched gold rows were held against."""
    return gold.filter("matched and strength is not null").groupBy("strength").agg(F.count("*").alias("n"))


def plausibility_sides(matched: DataFrame) -> DataFrame:
    """Sides as a constraint sees them: ours turned where the surface is inverted, gold's where the match was inverse."""
    ours, gold = F.col("surface_direction") == "inverted", F.col("direction") == "inverse"

    def turn(swap: Column, a: str, b: str) -> Column:
        return F.when(swap, F.col(b)).otherwise(F.col(a))

    return matched.withColumns({
        "subject_type_id": turn(ours, "subject_type_id", "object_type_id"), "object_type_id": turn(ours, "object_type_id", "subject_type_id"),
        "gold_domain": turn(gold, "gold_domain", "gold_range"), "gold_range": turn(gold, "gold_range", "gold_domain"),
    })
