"""Which project a conversation belongs to, by its words, names and aliases; versions of what was learned from runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Words that say nothing of a project, and titles that say nothing.
STOP = (
    "the", "and", "for", "with", "that", "this", "from", "have", "will", "would", "should", "could", "what", "when", "where", "which", "about", "into", "your", "you", "our", "are", "was", "were", "has", "had", "not",
    "but", "can", "how", "why", "use", "using", "need", "want",
)
GENERIC = r"(?i)^(new chat|chat|conversation|untitled(?: conversation| project)?|claude conversation \d+|gemini conversation \d+|conversation \d+)$"
NAMES = r"(?:[A-Z][A-Za-z0-9.+#-]{2,})(?: [A-Z][A-Za-z0-9.+#-]{2,}){0,3}"


def tokens(c: Column) -> Column:
    return F.filter(F.split(T.lower_ascii(T.normalize_text(c)), "[^a-z0-9.+#-]+"), lambda x: (F.length(x) >= 3) & ~x.isin(*STOP))


def names(c: Column) -> Column:
    """Capitalised runs of one to four words, lower-cased, four characters at least."""
    return F.filter(F.transform(F.regexp_extract_all(T.normalize_text(c), F.lit(NAMES), 0), F.lower), lambda x: F.length(x) >= 4)


def generic_title(c: Column) -> Column:
    t = F.regexp_replace(T.normalize_text(c), r"\s*\(\d{4}-\d{2}-\d{2}\)$", "")
    return (t == "") | t.rlike(GENERIC)


def top_words(rows: DataFrame, key: str, words: Column, n: int) -> DataFrame:
    """The n most frequent words of each key, ties by the alphabet: key, word, n, rank."""
    counts = rows.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fingerprints(messages: DataFrame) -> DataFrame:
    """conv_id with content (28 words, a user's counted twice) and names (16)."""
    twice = messages.select("conv_id", "text").union(messages.where("role = 'user'").select("conv_id", "text"))
    gathered = lambda d, name: d.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias(name))
    content = gathered(top_words(twice, "conv_id", tokens(F.col("text")), 28), "content")
    named = gathered(top_words(messages, "conv_id", names(F.col("text")), 16), "names")
    none = F.array().cast("array<string>")
    return messages.select("conv_id").distinct().join(content, "conv_id", "left").join(named, "conv_id", "left").select("conv_id", F.coalesce("content", none).alias("content"), F.coalesce("names", none).alias("names"))


#: Blocks that projects are dealt to, and lanes that conversations are; a task holds one of either. A block of 20,000 projects takes about 20 MB.
BLOCKS, LANES = 4, 64


def _best_two(rows: pd.DataFrame, projects: pd.DataFrame) -> pd.DataFrame:
    """The two best of a block's projects for each conversation of a lane, of those with a word or a name in common: counts of common words are sums over the places of a word, so no pair is a row."""
    ids, out = sorted(projects["project_id"]), []
    at = {p: i for i, p in enumerate(ids)}
    places: tuple[dict, dict] = {}, {}
    n_terms, n_names = np.zeros(len(ids)), np.zeros(len(ids))
    for p, terms, names_ in zip(projects["project_id"], projects["terms"], projects["names"], strict=True):
        for words, found, size in ((set(terms), places[0], n_terms), (set(names_), places[1], n_names)):
            size[at[p]] = len(words)
            for w in words:
                found.setdefault(w, []).append(at[p])
    index = tuple({w: np.array(x) for w, x in found.items()} for found in places)

    def common(words, k):
        hits = [index[k][w] for w in words if w in index[k]]
        return np.bincount(np.concatenate(hits), minlength=len(ids)) if hits else np.zeros(len(ids), np.int64)

    for conv, content, names_ in zip(rows["conv_id"], rows["content"], rows["names"], strict=True):
        first, most, every, named = set(content[:12]), set(content[:20]), set(content), set(names_)
        n12 = common(first, 0)
        n20 = n12 + common(most - first, 0)
        shared = n20 + common(every - most, 0)
        n_named = common(named, 1)
        exact = n_named + common(every - named, 1) > 0
        met = exact | (shared > 0) | (common(named - every, 0) > 0)
        if not met.any():
            continue
        union, union_named = len(most) + n_terms - n20, len(named) + n_names - n_named
        evidence = np.maximum(n20 / np.maximum(union, 1), n12 / max(len(first), 1))
        score = 0.46 * evidence + 0.18 * (n_named / np.maximum(union_named, 1)) + 0.12 * exact
        score = np.where(met, np.round(np.clip(score, 0.0, 1.0), 9), -1.0)
        for _ in range(2):  # of equal scores the smallest id is the first
            i = int(score.argmax())
            if score[i] >= 0:
                out.append((conv, ids[i], float(score[i]), int(shared[i])))
                score[i] = -1.0
    return pd.DataFrame(out, columns=["conv_id", "project_id", "score", "shared"])


def project_scores(prints: DataFrame, projects: DataFrame, blocks: int = BLOCKS, lanes: int = LANES) -> DataFrame:
    """Of the projects that a conversation shares a word or a name with, the two best of each block: project_id, score, shared words. Projects have an id of their own, terms and names.

    Every conversation meets every project, in the tasks: what is shuffled and kept grows with either side and not with their product. Titles are taken for generic, so content, names and exact names count.
    """
    block, lane = F.explode(F.array(*map(F.lit, range(blocks)))).alias("block"), F.explode(F.array(*map(F.lit, range(lanes)))).alias("lane")
    own = prints.select("conv_id", "content", "names", block, F.pmod(F.xxhash64("conv_id"), F.lit(lanes)).cast("int").alias("lane"))
    theirs = projects.select("project_id", "terms", "names", F.pmod(F.xxhash64("project_id"), F.lit(blocks)).cast("int").alias("block"), lane)
    types = {f.name: f.dataType.simpleString() for f in (*prints.schema, *projects.schema)}
    keys = ["block", "lane"]
    return own.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(_best_two, f"conv_id {types['conv_id']}, project_id {types['project_id']}, score double, shared int")


def matched(scores: DataFrame) -> DataFrame:
    """The project of each conversation: the best, if it is good enough, shares three words and leads by .08."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "project_id")
    ranked = scores.withColumns({"place": F.row_number().over(w), "runner": F.lead("score").over(w)}).where("place = 1")
    accepted = (F.col("score") >= 0.14) & (F.col("shared") >= 3) & (F.col("runner").isNull() | (F.col("score") >= F.col("runner") + 0.08))
    return ranked.select("conv_id", "project_id", "score", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def resolved(prints: DataFrame, projects: DataFrame) -> DataFrame:
    """Every conversation's project: one that it matches, else a new one named after its first words."""
    found = matched(project_scores(prints, projects)).where("accepted").select("conv_id", "project_id", "score")
    key = F.array_join(F.array_sort(F.concat(F.slice("content", 1, 12), F.slice("names", 1, 8))), "|")
    name = F.when(F.size("content") > 0, F.array_join(F.transform(F.slice("content", 1, 4), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), " · ")).otherwise("Unresolved conversation")
    new = T.canonical_id("proj", "1", F.lit("project"), F.when(key == "", F.lower(name)).otherwise(key))
    rows = prints.join(found, "conv_id", "left")
    sure = F.when(F.size(F.array_union("content", "names")) >= 4, 0.82).otherwise(0.62)
    return rows.select("conv_id", F.coalesce("project_id", new).alias("project_id"), F.when(F.col("project_id").isNull(), name).alias("new_name"), F.coalesce("score", sure).alias("confidence"))


def trajectory_key(task: Column) -> Column:
    """The first eight terms, sorted, 160 characters at most."""
    terms = F.array_sort(F.slice(T.terms(task), 1, 8))
    return F.substring(F.when(F.size(terms) > 0, F.array_join(terms, " ")).otherwise(T.normalize_identity(task)), 1, 160)


def compiled(runs: DataFrame) -> DataFrame:
    """What runs (run_id, at, task, project_id, status, stages, n_evidence) leave behind: trajectory, outcome, and of passed ones with evidence the capability's version, state and the one before it."""
    c = F.col
    has = lambda s: F.array_contains("stages", s)
    model = F.exists("stages", lambda x: x.startswith("MODEL_"))
    verdict = F.when(c("status") == "SOLVED", "PASS").when(c("status") == "BLOCKED_EXTERNAL_DEPENDENCY", "PENDING").otherwise("FAIL")
    ended = F.when(has("RESIDUAL_REPAIR"), "REPAIR").when(model, "MRS_MODEL").when(has("TINY_SPECIALIST"), "TINY_SPECIALIST").otherwise("BRANCH_ZERO")
    rows = runs.withColumns({"key": trajectory_key(c("task")), "verification": verdict, "ended_by": ended, "model": model})
    rows = rows.withColumn("outcome", F.when(c("verification") == "PASS", "SUCCESS").when(has("RESIDUAL_REPAIR"), "REPAIR").otherwise("FAILURE"))
    good = (c("verification") == "PASS") & (c("n_evidence") > 0)
    w = Window.partitionBy("key", "project_id", "good").orderBy("at", "run_id")
    own = rows.withColumn("good", good).withColumns({"version": F.row_number().over(w), "rollback": F.lag("run_id").over(w)})
    state = F.when(~c("model") & (c("version") >= 2), "VERIFIED").when(~c("model"), "REPLAY_VERIFIED").otherwise("CANDIDATE")
    kept = lambda x: F.when(c("good"), x)
    return own.select("run_id", "key", "project_id", "verification", "outcome", "ended_by", kept(c("version")).alias("version"), kept(c("rollback")).alias("rollback"), kept(state).alias("state"))
