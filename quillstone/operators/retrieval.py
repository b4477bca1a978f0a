"""Ranked retrieval over records of several tables, evidence bundles, routes.

Records have table_name, record_id, project_id, source_id, conv_id, text, status, kind, confidence, updated_at. An index row
holds a record's lower-cased text and hash; only the few candidates of a query are normalised and scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

# What a query's route is known by, and each route's terms, candidates, boost of current truths and diversity.
TEMPORAL = r"\b(current|currently|latest|now|changed|change|before|after|timeline|history|supersed|replaced|decision|decided|version|status|what are we using|what did we decide)\b"
HETEROGENEOUS = r"\b(compare|comparison|relationship|relate|connect|connection|across|contradiction|conflict|why|cause|depends|dependency|multiple|projects|pattern)\b"
ROUTES = {"F_TEMPORAL_TRUTH": (16, 192, 3.2, 0.2), "G_ADAPTIVE_HETEROGENEOUS": (14, 320, 2.4, 0.9), "B_250_CHUNK": (14, 256, 2.2, 0.35)}
RECORD = ("table_name", "record_id", "project_id", "source_id", "conv_id", "text", "status", "kind", "confidence", "updated_at")
_SPACE = T.WS.replace(r"\x{0b}", r"\x0b").replace(r"\x{a0}", r"\xa0")


def route_of(query: Column) -> Column:
    """The route of each query of a column."""
    norm = T.normalize_text(query)
    return F.when(R.has(norm, TEMPORAL), "F_TEMPORAL_TRUTH").when(R.has(norm, HETEROGENEOUS), "G_ADAPTIVE_HETEROGENEOUS").otherwise("B_250_CHUNK")


def plan_columns(query: Column, limit: int = 24) -> list[Column]:
    """route, terms, candidate_cap, truth_boost, diversity and budget of each query of a column."""
    route, cap = route_of(query), max(1, min(256, limit))
    pick = lambda i: reduce(lambda out, r: F.when(route == r, ROUTES[r][i]).otherwise(out), ("F_TEMPORAL_TRUTH", "G_ADAPTIVE_HETEROGENEOUS"), F.lit(ROUTES["B_250_CHUNK"][i]))
    budget = F.when(F.lit(cap <= 32) & (pick(1) <= 192), "TINY").when(F.lit(cap <= 96) & (pick(1) <= 320), "BALANCED").otherwise("DEEP")
    terms = F.when(route == "F_TEMPORAL_TRUTH", T.unicode_terms(query, 16)).otherwise(T.unicode_terms(query, 14))
    return [route.alias("route"), terms.alias("terms"), F.greatest(pick(1), F.lit(cap)).alias("candidate_cap"), pick(2).alias("truth_boost"), pick(3).alias("diversity"), budget.alias("budget")]


@dataclass(frozen=True)
class Plan:
    query: str
    route: str
    terms: list[str]
    candidates: int
    results: int
    truth_boost: float
    diversity: float


def plan(query: str, limit: int = 24, candidate_limit: int = 256) -> Plan:
    """How one query is answered."""
    norm = re.sub(r"\s+", " ", query).strip()
    found = lambda p: re.search(p, norm, re.IGNORECASE | re.ASCII)
    route = "F_TEMPORAL_TRUTH" if found(TEMPORAL) else "G_ADAPTIVE_HETEROGENEOUS" if found(HETEROGENEOUS) else "B_250_CHUNK"
    n, cap, boost, diversity = ROUTES[route]
    terms = list(dict.fromkeys(t for t in re.split(r"[^\w-]+", norm.lower()) if len(t) >= 2))[:n]
    results = max(1, min(256, limit))
    return Plan(norm.lower(), route, terms, min(candidate_limit, min(512, max(cap, results))), results, boost, diversity)


def record_hash() -> Column:
    return F.sha2(F.concat_ws(T.SEPARATOR, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RECORD)).cast("binary"), 256)


def index_of(records: DataFrame) -> DataFrame:
    """The index of records: their key, lower-cased text and status, hash and time."""
    return records.select("table_name", "record_id", F.lower(F.concat_ws(" ", "text", "status")).alias("low"), record_hash().alias("record_hash"), "updated_at")


def _hits(low: Column, terms: list[str]) -> Column:
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0))


def like_any(index: DataFrame, terms: list[str], tables: list[str] | None = None) -> DataFrame:
    """Index rows that contain one of the first eight terms (% and _ left out)."""
    own = index if tables is None else index.where(F.col("table_name").isin(*tables))
    return own.where(reduce(Column.__or__, (F.col("low").contains(re.sub("[%_]", "", t)) for t in terms[:8])))


def recent(index: DataFrame, n: int) -> DataFrame:
    return index.orderBy(F.desc("updated_at"), "table_name", "record_id").limit(n).withColumn("hits", F.lit(1))


def candidates(records: DataFrame, p: Plan, tables: list[str] | None = None) -> DataFrame:
    """The n records that contain most terms: a partial top-k in each task, over texts lower-cased once and neither normalised nor shuffled. Without terms, the newest."""
    own = records if tables is None else records.where(F.col("table_name").isin(*tables))
    if not p.terms:
        return own.orderBy(F.desc("updated_at"), "table_name", "record_id").limit(p.candidates).withColumn("hits", F.lit(1))
    low = F.transform(F.array(F.lower(F.concat_ws(" ", "text", "status"))), lambda x: F.struct(_hits(x, p.terms).alias("hits"), _any(x, p.terms).alias("liked")))
    scored = own.select(*RECORD, F.inline(low)).where("liked and hits > 0")  # generated, so that the filter doesn't compute it again
    return scored.orderBy(F.desc("hits"), "table_name", "record_id").limit(p.candidates).drop("liked")


def _any(low: Column, terms: list[str]) -> Column:
    return reduce(Column.__or__, (low.contains(re.sub("[%_]", "", t)) for t in terms[:8]))


def hydrated(found: DataFrame, records: DataFrame, most: int | None = None) -> DataFrame:
    """Index hits with their records, as long as the record still has the hash it was indexed with. Hits are broadcast only where they are known to be `most` at most, 512 or fewer; else both sides are shuffled."""
    base, hits = records.withColumn("actual", record_hash()), found.select("table_name", "record_id", "record_hash", "hits")
    if most is not None and most <= 512:
        hits = F.broadcast(hits.limit(most))
    return base.join(hits, ["table_name", "record_id"]).where("record_hash = actual").drop("actual")


# The tables behind a project's tabs; patterns are every project's.
TABS = {"now": "truths", "findings": "atoms", "patterns": "patterns", "evidence": "databoxes", "ticks": "ticks", "experiments": "experiments"}


def project_tab(records: DataFrame, project: str, tab: str) -> DataFrame:
    """Records that a tab of a project lists; an unknown tab is the first one."""
    own = records.where(F.col("table_name") == TABS.get(tab, TABS["now"]))
    return own if tab == "patterns" else own.where(F.coalesce("project_id", F.lit("")) == project)


def project_tabs(records: DataFrame, tabs: list[str] | None = None) -> DataFrame:
    """(tab, project_id, record_id) of the tabs of all projects at once; patterns, which are every project's, come with a null project."""
    names = F.map_from_arrays(F.array(*map(F.lit, TABS.values())), F.array(*map(F.lit, TABS)))
    rows = records.withColumn("tab", F.try_element_at(names, F.col("table_name"))).where(F.col("tab").isin(*(tabs or TABS)))
    own = F.when(F.col("tab") != "patterns", F.col("project_id"))
    return rows.where((F.col("tab") == "patterns") | (F.coalesce("project_id", F.lit("")) != "")).select("tab", own.alias("project_id"), "record_id")


def in_scope(rows: DataFrame, project: str | None) -> DataFrame:
    """Records of the project, and those of none."""
    return rows if not project else rows.where((F.coalesce("project_id", F.lit("")) == "") | (F.col("project_id") == project))


def ranked(found: DataFrame, p: Plan) -> DataFrame:
    """Scores of a query's candidates (at most 512 rows): evidence_id, the record, hits, score; of equal texts the best stays. The last limit is the feature's."""
    c = F.col
    rows = found.withColumn("norm", F.lower(T.normalize_text(F.concat_ws(" ", "text", "status"))))
    score = c("hits") + F.when(c("norm").contains(p.query), 5.0).otherwise(0.0) + _hits(c("norm"), p.terms) if p.query else c("hits") + _hits(c("norm"), p.terms)
    state = F.when(c("status") == "CURRENT", p.truth_boost).when(c("status") == "CONFLICTING", 1.3).when(c("status") == "PENDING_REVIEW", 0.6).otherwise(0.0)
    trust = F.coalesce("confidence", F.lit(0.0))
    own = F.when(c("table_name") == "truths", state + trust).when(c("table_name") == "atoms", trust + F.when(c("kind").isin("decision", "constraint"), 0.8).otherwise(0.0)).otherwise(0.0)
    key = [F.coalesce("project_id", F.lit("none")), F.coalesce("source_id", F.lit("none")), c("table_name")]
    seen = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("hits"), "table_name", "record_id")) - 1
    rows = rows.withColumn("score", F.round(score + own - seen * F.lit(p.diversity) * 0.15, 6))
    text = F.lower(T.normalize_text(F.coalesce("text", "record_id")))
    best = F.row_number().over(Window.partitionBy(text).orderBy(F.desc("score"), "record_id", "table_name"))
    kept = rows.withColumn("hash", record_hash()).withColumn("best", best).where("best = 1").orderBy(F.desc("score"), "record_id", "table_name").limit(p.results)
    return kept.withColumn("evidence_id", T.canonical_id("ev", "1", c("table_name"), c("record_id"), c("hash"))).select("evidence_id", *RECORD, "hits", "score", "hash")


def retrieve(records: DataFrame, query: str, limit: int = 24, tables: list[str] | None = None, project: str | None = None) -> DataFrame:
    """Ranked evidence for one query."""
    p = plan(query, limit)
    return ranked(in_scope(candidates(records, p, tables), project), p)


def search_mode(records: DataFrame, query: str, mode: str) -> DataFrame:
    """find, current, history, evidence or discover: which tables are asked and which statuses stay."""
    tables = {"current": ["truths"], "history": ["truths"], "evidence": ["atoms", "messages", "truths"], "discover": ["atoms"]}.get(mode)
    found = retrieve(records, query or ("idea decision constraint task" if mode == "discover" else ""), 100, tables)
    return found.where("status = 'CURRENT'") if mode == "current" else found.where("status is null or status <> 'CURRENT'") if mode == "history" else found


def _evidence_columns() -> dict[str, Column]:
    c = F.col
    return {
        "evidence_id": c("evidence_id"), "type": c("table_name"), "record_id": c("record_id"), "text": T.normalize_text(F.coalesce("text", F.lit(""))), "project_id": c("project_id"), "source_id": c("source_id"),
        "message_id": F.when(c("table_name") == "messages", c("record_id")), "truth_status": F.when(c("table_name") == "truths", c("status")), "updated_at": c("updated_at"), "score": c("score"), "hash": c("hash"),
    }


def evidence(found: DataFrame) -> DataFrame:
    """What a bundle says of each piece."""
    return found.select(*(column.alias(name) for name, column in _evidence_columns().items()))


def _bundled() -> list[Column]:
    """Aggregates of a bundle over its evidence in rank order."""
    c, e = F.col, _evidence_columns()
    line = F.concat_ws(T.SEPARATOR, *(F.coalesce(e[x].cast("string"), F.lit("")) for x in ("evidence_id", "type", "text", "project_id", "source_id", "message_id", "truth_status", "updated_at")))
    return [
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("score")).alias("s"), "record_id", line.alias("line")))), lambda x: x["line"]), "|").cast("binary"), 256).alias("evidence_hash"),
        F.count("*").alias("n_evidence"), F.count_distinct(F.when(c("source_id") != "", c("source_id"))).alias("sources"), F.count_if(e["truth_status"] == "CURRENT").alias("current_truths"), F.count_if(e["truth_status"] == "CONFLICTING").alias("conflicts"),
    ]


def _hashed(one: DataFrame, query: str, root: str, project: str | None) -> DataFrame:
    """A bundle's aggregates with its id, query, route and hash."""
    p = plan(query)
    head = [F.lit(x) for x in (root, p.query, project or "", p.route)]
    one = one.withColumns({"query": head[1], "route": head[3], "id": T.canonical_id("databox", "1", *head, F.col("evidence_hash"))})
    return one.withColumn("hash", F.sha2(F.concat_ws(T.SEPARATOR, "id", *head, "evidence_hash", *(F.col(x).cast("string") for x in ("sources", "current_truths", "conflicts"))).cast("binary"), 256))


def databox(found: DataFrame, query: str, root: str, project: str | None = None) -> DataFrame:
    """One row: the bundle's id, counts and hashes over its evidence (at most 256 pieces) in rank order."""
    return _hashed(found.agg(*_bundled()), query, root, project)


def verified(box: DataFrame, found: DataFrame, query: str, root: str, project: str | None = None) -> DataFrame:
    """id and whole: whether a bundle's hashes are those of its evidence."""
    again = databox(found, query, root, project).select(F.col("id").alias("id2"), F.col("evidence_hash").alias("e2"), F.col("hash").alias("h2"))
    return box.crossJoin(again).select("id", ((F.col("id") == F.col("id2")) & (F.col("evidence_hash") == F.col("e2")) & (F.col("hash") == F.col("h2"))).alias("whole"))  # two single rows


def _placed(found: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.orderBy(F.desc("score"), "record_id", "table_name"))  # at most 256 rows
    return found.withColumns({"place": place, "low": F.lower(T.normalize_text(F.coalesce("text", F.lit(""))))})


def _carried(query: str) -> list[Column]:
    """Aggregates of a query's sufficiency over its placed evidence."""
    terms, c = plan(query).terms, F.col
    terms = list(dict.fromkeys(t for t in re.split(r"[^\w-]+", query.lower()) if len(t) >= 2))[:32] if terms else []
    covered = sum((F.max(F.when((c("place") <= 12) & c("low").contains(t), 1).otherwise(0)) for t in terms), F.lit(0))
    trust = F.coalesce("confidence", F.least(c("score") / 6, F.lit(1.0)))
    return [
        (F.coalesce(covered, F.lit(0)) / max(1, len(terms)) if terms else F.lit(1.0)).alias("coverage"), F.count("*").alias("n"), F.coalesce(F.avg(F.when(c("place") <= 4, trust)), F.lit(0.0)).alias("semantic"),
        F.coalesce(F.bool_or((c("table_name") == "truths") & (c("status") == "CURRENT")), F.lit(False)).alias("current"), F.coalesce(F.bool_or(c("status").isin("CONFLICTING", "PENDING_REVIEW")), F.lit(False)).alias("conflict"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("best"),
    ]


def _judged(one: DataFrame) -> DataFrame:
    """These aggregates with score and state."""
    c, bonus = F.col, lambda condition: F.when(condition, 0.08).otherwise(0.0)
    score = c("coverage") * 0.46 + c("semantic") * 0.28 + F.least(c("n") / 4, F.lit(1.0)) * 0.14 + bonus(c("current")) + bonus(c("best") >= 4) - bonus(c("conflict"))
    one = one.withColumn("score", F.round(T.clamp(score), 6))
    return one.withColumn("state", F.when(c("score") >= 0.72, "SUFFICIENT").when(c("score") >= 0.5, "AMBIGUOUS").otherwise("INSUFFICIENT"))


def sufficiency(found: DataFrame, query: str) -> DataFrame:
    """One row: how far a query's evidence carries an answer (score, coverage, n, state)."""
    return _judged(_placed(found).agg(*_carried(query))).select("score", F.round("coverage", 6).alias("coverage"), "n", "state")


def job(found: DataFrame, query: str, root: str, created: str, project: str | None = None, limit: int = 24) -> DataFrame:
    """One row: a question with all that an answer may rest on: its bundle's hashes, the ids of its evidence in rank order, how far these carry, and the route that is taken where they don't.

    `created` is part of the id, so one question asked twice makes two jobs. A question without words is an error; one without evidence has empty lists.
    """
    p, c = plan(query, limit), F.col
    if not p.query:
        raise ValueError("a job needs a question")
    pieces = F.array_sort(F.collect_list(F.struct((-c("score")).alias("s"), "record_id", "table_name", "evidence_id"))).alias("x")  # at most 256 pieces
    one = _judged(_hashed(_placed(found).agg(*_bundled(), *_carried(query), pieces), query, root, project))  # the evidence is found once
    one = one.select(
        c("id").alias("databox_id"), c("hash").alias("databox_hash"), "evidence_hash", "n_evidence", "route", c("score").alias("sufficiency"), c("state").alias("sufficiency_state"),
        c("x.evidence_id").alias("evidence_ids"), c("x.record_id").alias("record_ids"),
    )
    lacks = c("sufficiency_state") != "SUFFICIENT"
    one = one.withColumns({
        "question": F.lit(p.query), "project_id": F.lit(project).cast("string"), "memory_root": F.lit(root), "created": F.lit(created), "candidate_cap": F.lit(p.candidates), "used_fallback": lacks,
        "fallback": F.when(lacks | (c("route") != "B_250_CHUNK"), "B_250_CHUNK"), "job_id": T.canonical_id("job", "2", F.lit(root), F.lit(p.query), F.lit(project or ""), c("databox_hash"), F.lit(created)),
    })
    fields = ("job_id", "created", "question", "project_id", "memory_root", "databox_hash", "evidence_hash", "route", "fallback", "candidate_cap", "sufficiency", "sufficiency_state")
    line = F.concat_ws(T.SEPARATOR, *(F.coalesce(c(f).cast("string"), F.lit("")) for f in fields), F.array_join("evidence_ids", ","))
    return one.withColumn("hash", F.sha2(line.cast("binary"), 256))


def job_answers(jobs: DataFrame, cited: DataFrame) -> DataFrame:
    """Answers (answer_id, job_id, evidence_id, a row for each citation) against their jobs: answer_id, n_cited, n_outside (not among the job's evidence), status PASS or FAIL.

    An answer without any citation (a null evidence_id) and one to a job that isn't known fail.
    """
    allowed = jobs.select("job_id", F.explode("evidence_ids").alias("evidence_id")).distinct().withColumn("allowed", F.lit(True))
    rows = cited.select("answer_id", "job_id", "evidence_id").distinct().join(allowed, ["job_id", "evidence_id"], "left")
    one = rows.groupBy("answer_id").agg(F.count("evidence_id").alias("n_cited"), F.count_if(F.col("evidence_id").isNotNull() & F.col("allowed").isNull()).alias("n_outside"))
    return one.withColumn("status", F.when((F.col("n_cited") > 0) & (F.col("n_outside") == 0), "PASS").otherwise("FAIL"))


def local_chunk(norm: Column, start: Column, end: Column, cap: int = 250) -> Column:
    """struct(text, first, count): `cap` tokens of normalised text around the token at the middle of start and end; all of a shorter text."""
    tokens = F.split(norm, " ")
    anchor = F.floor((start + end) / 2).cast("int")
    # the token that holds the anchor: as many as begin before it
    center = F.greatest(F.size(F.split(F.substring(norm, 1, 1 << 30).substr(F.lit(1), anchor + 1), " ")) - 1, F.lit(0))
    n = F.size(tokens)
    right = F.least(F.greatest(center - cap // 2, F.lit(0)) + cap, n)
    left = F.greatest(right - cap, F.lit(0))
    some = F.struct(F.array_join(F.slice(tokens, left + 1, cap), " ").alias("text"), left.alias("first"), (right - left).alias("count"))
    return F.when(norm == "", F.struct(F.lit("").alias("text"), F.lit(0).alias("first"), F.lit(0).alias("count"))).when(n <= cap, F.struct(norm.alias("text"), F.lit(0).alias("first"), n.alias("count"))).otherwise(some)


def operation(task: Column) -> Column:
    q = F.lower(task)
    return F.when(q.contains("contradict") | q.contains("conflict"), "CHECK_CONTRADICTION").when(q.contains("compare"), "COMPARE").when(q.contains("find") | q.contains("retrieve"), "RETRIEVE").otherwise("SYNTHESIZE")


def routed(tasks: DataFrame) -> DataFrame:
    """How each task (task_id, task, n_records, n_conflicts, capability_id) is answered: stage and status, the first that can."""
    q, c = F.lower(F.trim("task")), F.col
    op = operation(c("task"))
    counted = q.isin("how many sources?", "source count")
    listed = (q.contains("show") | q.contains("list")) & q.contains("evidence")
    special = ((op == "RETRIEVE") & (c("n_records") > 0)) | ((op == "CHECK_CONTRADICTION") & (c("n_conflicts") > 0))
    stage = F.when((q == "") | counted | listed, "BRANCH_ZERO").when(c("capability_id").isNotNull(), "CAPABILITY").when(special, "TINY_SPECIALIST").otherwise("HARD_RESIDUAL")
    return tasks.withColumns({"operation": op, "stage": stage}).withColumn("status", F.when(c("stage") == "HARD_RESIDUAL", "BLOCKED_EXTERNAL_DEPENDENCY").otherwise("SOLVED"))


def best_matches(docs: DataFrame, items: DataFrame, accept: float = 0.16) -> DataFrame:
    """For each item, the document whose terms are most like its own by Jaccard, the smallest id on ties.

    Items are few; their vocabulary and term lists travel to the documents when they are small. A document keeps only the items' words,
    and a pair counts only where sizes allow `accept`.
    """
    i = items.select("item_id", T.terms(F.col("text")).alias("ts")).where(F.size("ts") > 0)
    posts = i.select("item_id", F.size("ts").alias("ni"), F.explode("ts").alias("t"))
    d = docs.select("doc_id", F.inline(F.transform(F.array(T.terms(F.col("text"))), lambda ts: F.struct(F.size(ts).alias("nd"), ts.alias("ts")))))
    vocabulary = posts.agg(F.collect_set("t").alias("v"), F.min("ni").alias("least"), F.max("ni").alias("most"), F.sum(F.octet_length("t") + 32).alias("bytes"))
    bound = vocabulary.first()
    if not bound.v:
        return docs.select(F.lit(0).cast("bigint").alias("item_id"), "doc_id", F.lit(0.0).alias("similarity")).limit(0)
    # |A & B| / |A | B| >= t needs sizes within a ratio of t
    near = d.where((F.col("nd") * accept <= bound.most) & (F.col("nd") >= bound.least * accept))
    words = near.select("doc_id", "nd", F.explode("ts").alias("t"))
    both = words.join(F.broadcast(posts) if bound.bytes <= 8 << 20 else posts, "t").where((F.col("ni") >= F.col("nd") * accept) & (F.col("nd") >= F.col("ni") * accept))
    overlap = both.groupBy("item_id", "doc_id", "ni", "nd").agg(F.count("*").alias("n")).withColumn("similarity", F.round(F.col("n") / (F.col("ni") + F.col("nd") - F.col("n")), 9)).where(F.col("similarity") >= accept)
    return overlap.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "similarity"), F.struct("similarity", (-F.col("doc_id")).alias("o"))).alias("m")).select("item_id", "m.doc_id", "m.similarity")
