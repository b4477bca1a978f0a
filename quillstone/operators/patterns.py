"""Patterns that statements recur in, their tests, and what can be carried to other projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KINDS = ("decision", "constraint", "fact", "task", "idea")
LAST_ATOMS, LAST_COUNTERS = 300, 100


def pattern_key():
    """Kind and the first four subject words, sorted; of a statement without a subject, its first three keywords."""
    subject = T.normalize_identity(F.coalesce("subject", F.lit("")))
    source = F.when(subject != "", subject).otherwise(F.array_join(F.array_sort(F.slice("keywords", 1, 3)), " "))
    words = F.array_sort(F.slice(F.filter(F.split(source, " "), lambda x: x != ""), 1, 4))
    return F.concat_ws(":", "kind", F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise("unresolved"))


def pattern_label():
    label = T.normalize_text(F.coalesce("subject", F.array_join(F.slice("keywords", 1, 3), " ")))
    return F.when(label != "", label).otherwise(F.concat("kind", F.lit(" pattern")))


def conflicting(truths: DataFrame) -> DataFrame:
    """atom_id of the evidence of CONFLICTING truths."""
    return truths.where("status = 'CONFLICTING'").select(F.explode(F.coalesce("evidence_ids", F.array("atom_id"))).alias("atom_id")).where("atom_id <> ''").distinct()


def _last(rows: DataFrame, n: int, name: str) -> DataFrame:
    """The last n statements of each pattern, in order; only these are gathered."""
    w = Window.partitionBy("pattern_key").orderBy(F.desc("ord"))
    kept = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return kept.groupBy("pattern_key").agg(F.array_sort(F.collect_list(F.struct("ord", "atom_id"))).getField("atom_id").alias(name))


def observed(atoms: DataFrame, truths: DataFrame) -> DataFrame:
    """Patterns of three statements at least, in the order of created_at and atom_id: counts, projects, last statements and counterexamples, strength and status."""
    rows = atoms.where(F.col("kind").isin(*KINDS)).select("atom_id", "kind", "project_id", pattern_key().alias("pattern_key"), pattern_label().alias("label"), F.struct("created_at", "atom_id").alias("ord"))
    rows = rows.join(conflicting(truths).withColumn("counter", F.lit(True)), "atom_id", "left").withColumn("counter", F.coalesce("counter", F.lit(False)))
    found = rows.groupBy("pattern_key").agg(
        F.count("*").alias("n"), F.count_if("counter").alias("counters"), F.array_sort(F.collect_set(F.when(F.col("project_id") != "", F.col("project_id")))).alias("project_ids"), F.min_by("label", "ord").alias("label"),
    ).where("n >= 3")
    found = found.join(_last(rows, LAST_ATOMS, "atom_ids"), "pattern_key").join(_last(rows.where("counter"), LAST_COUNTERS, "counter_ids"), "pattern_key", "left")
    found = found.withColumns({"counters": F.least("counters", F.lit(LAST_COUNTERS)), "projects": F.size("project_ids"), "counter_ids": F.coalesce("counter_ids", F.array().cast("array<string>"))})
    strength = T.clamp(0.28 + F.log2(F.col("n") + 1) / 9 + F.least(F.lit(0.24), 0.06 * F.col("projects")) - 0.45 * F.col("counters") / F.col("n"))
    wide = F.col("projects") >= 2
    return found.select(
        T.canonical_id("pat", "1", F.col("pattern_key")).alias("pattern_id"), "pattern_key", "label", "n", "projects", "counters", "project_ids", "atom_ids", "counter_ids", F.round(strength, 9).alias("strength"),
        F.when((F.col("n") >= 12) & wide, "TESTING").when((F.col("n") >= 7) & wide, "CANDIDATE").otherwise("OBSERVED").alias("status"),
        F.when((F.col("n") >= 7) & wide, "L3_HYPOTHESIS").otherwise("L2_CANDIDATE").alias("maturity"),
        F.when((F.col("n") >= 12) & wide, F.when(F.col("counters") > 0, "COUNTEREXAMPLE_FOUND").otherwise("NEEDS_TRANSFER_TEST")).otherwise("UNTESTED").alias("verification"),
    )


def evaluated(patterns: DataFrame, tests: DataFrame) -> DataFrame:
    """Patterns with what their tests (pattern_id, test_id, kind, status, domain, project_id) say: status, maturity, verification, falsification, strength."""
    passed, failed, kind = F.col("status") == "PASS", F.col("status") == "FAIL", F.col("kind")
    domain = T.normalize_text(F.coalesce("domain", "project_id", F.lit("")))
    counts = tests.groupBy("pattern_id").agg(
        F.count("*").alias("tests"), F.count_if(passed).alias("passes"), F.count_if(failed).alias("fails"), F.count_if(passed & (kind == "REPLICATION")).alias("replicated"), F.count_if(passed & (kind == "FALSIFICATION")).alias("survived"),
        F.count_if(kind == "FALSIFICATION").alias("tried"), F.count_if(failed & kind.isin("COUNTEREXAMPLE", "FALSIFICATION")).alias("broken"), F.count_distinct(F.when(passed & (kind == "TRANSFER") & (domain != ""), domain)).alias("domains"),
    )
    names = ("tests", "passes", "fails", "replicated", "survived", "tried", "broken", "domains")
    rows = patterns.join(counts, "pattern_id", "left").na.fill(0, list(names))
    c = F.col
    general = (c("domains") >= 2) & (c("replicated") >= 1) & (c("survived") >= 1) & (c("broken") == 0)
    tested = (c("n") >= 7) | (c("tests") > 0)
    support = T.clamp(c("strength") * 0.45 + F.least(c("passes") / 4, F.lit(1.0)) * 0.35 + F.least(c("domains") / 2, F.lit(1.0)) * 0.2 - c("fails") * 0.2)
    maturity = F.when(general, "L6_GENERALIZED").when((c("replicated") >= 2) & (c("fails") == 0), "L5_REPLICATED").when((c("replicated") >= 1) & (c("fails") == 0), "L4_SUPPORTED").when(c("n") >= 7, "L3_HYPOTHESIS").when(c("n") >= 3, "L2_CANDIDATE")
    return rows.withColumns({
        "status": F.when(c("broken") > 0, "TESTING").when(general, "VERIFIED").when(tested, "TESTING").otherwise(c("status")), "maturity": F.coalesce(maturity, c("maturity")),
        "verification": F.when(c("broken") > 0, "COUNTEREXAMPLE_FOUND").when(general, "VERIFIED_EXTERNAL").when(tested, "NEEDS_TRANSFER_TEST").otherwise(c("verification")),
        "falsification": F.when(general | ((c("tried") > 0) & (c("broken") == 0) & (c("survived") > 0)), "SURVIVED").when(c("tried") == 0, "UNTESTED").when(c("broken") > 0, "FAILED").otherwise("ACTIVE"),
        "strength": F.greatest(c("strength"), F.round(support, 9)),
    }).drop(*names)


def ranked(patterns: DataFrame, n: int = 250) -> DataFrame:
    return patterns.orderBy(F.desc("strength"), F.desc("n"), "pattern_key").limit(n)


def portable(patterns: DataFrame) -> DataFrame:
    """What may be carried to other projects: patterns that are VERIFIED and generalised, with a confidence."""
    kept = patterns.where("status = 'VERIFIED' and maturity = 'L6_GENERALIZED'")
    return kept.select(T.canonical_id("exp", "1", F.col("pattern_id")).alias("id"), "pattern_id", F.col("label").alias("title"), F.col("project_ids").alias("domains"), F.slice("atom_ids", 1, 100).alias("provenance"), F.col("strength").alias("confidence"))
