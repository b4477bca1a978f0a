"""Statements as atoms, and the truths that they make of each other."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import records
from .conversations import messages

VERSION = "1"


def placed_sentences(norm):
    """array<struct<sentence, start>> of normalised text: the sentences of four characters or more and where they begin, or the whole text."""
    parts = F.split(norm, r"(?<=[.!?]) +")
    none = F.array().cast("array<struct<sentence:string,start:int>>")

    def step(acc, x):
        own = F.struct(x.alias("sentence"), acc["at"].alias("start"))
        return F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.when(F.length(x) >= 4, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    whole = F.array(F.struct(norm.alias("sentence"), F.lit(0).alias("start")))
    return F.element_at(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).when(norm != "", whole).otherwise(none)), 1)


def atomize(conversations: DataFrame, projects: int = 7) -> DataFrame:
    """Statements with identity, place, features and strict family. A conversation belongs to one of `projects`, by its id."""
    rows = messages(conversations).withColumns({
        "project_id": F.concat(F.lit("p"), (F.col("conv_id") % projects).cast("string")),
        "message_id": T.canonical_id("msg", VERSION, F.col("conv_id"), F.col("sequence")), "norm": T.normalize_text(F.col("text")),
    })
    each = rows.select("project_id", "conv_id", "message_id", "sequence", "role", F.posexplode(placed_sentences(F.col("norm"))).alias("index", "s"))
    each = each.select("*", F.col("s.sentence").alias("text"), F.col("s.start").alias("source_start")).drop("s")
    own = T.ascii_words(F.col("text"))
    each = each.withColumns({"words": own, "kind": T.statement_kind(F.col("text")), "polarity": T.polarity(F.col("text"))})
    subject = F.when(F.size("words") > 0, F.array_join(F.slice("words", 1, 8), " ")).otherwise(F.col("text"))
    each = each.withColumns({"subject": subject, "value": T.statement_value(F.col("text"), F.col("kind")), "keywords": F.slice("words", 1, 12)})
    each = each.withColumns({"rule": R.strict_rule(F.col("role"), F.col("text"), F.col("kind")), "confidence": R.intrinsic_sufficiency(F.col("text"), F.col("subject"), F.col("value"))})
    trace = F.array(F.concat(F.lit("strict_truth:"), F.col("rule.family")), F.when(F.col("rule.eligible"), "strict_truth:eligible").otherwise("strict_truth:residual"))
    return each.select(
        T.canonical_id("atom", VERSION, F.col("message_id"), F.col("index"), F.col("text")).alias("atom_id"), "project_id", "conv_id", "message_id", "sequence", "role", "index", "text",
        "kind", "subject", "value", F.lit(None).cast("string").alias("scope"), "polarity", "keywords", "confidence", "source_start", (F.col("source_start") + F.length("text")).alias("source_end"),
        "rule.family", "rule.tier", "rule.eligible", "rule.blocked", trace.alias("rule_trace"),
    )


def may_be_truth():
    """Whether a statement may become a truth: a user's, of four kinds, with no blocking family."""
    blocked = F.col("blocked") | F.arrays_overlap("rule_trace", F.array(*(F.lit(f"strict_truth:{b}") for b in R.BLOCKING)))
    return ~blocked & (F.col("role") == "user") & F.col("kind").isin(*R.TRUTH_KINDS) & (F.coalesce("project_id", F.lit("")) != "")


def truth_candidates(atoms: DataFrame) -> DataFrame:
    """Statements that may become truths."""
    return atoms.where(may_be_truth())


_FOLDED = (
    "truth_id string, ord bigint, project_id string, kind string, conv_id bigint, atom_id string, text string, subject string, value string, polarity string, scope string, "
    "confidence double, status string, relation string, related string, supersedes string, turn bigint"
)


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


#: Fixed value: the likeness from which a truth is one that a statement is about.
LEAST_LIKE = 0.25


def _decide(a, t, update: bool, unsure: bool) -> str:
    """The relation of a statement to a truth, from features that columns have computed."""
    if a.conv_id is not None and t.conv_id is not None and a.conv_id != t.conv_id:
        return "UNCERTAIN"
    if a.ident == t.ident:
        return "SAME"
    keys, about = set(a.keys), set(t.terms[:10])
    s = max(_jaccard(frozenset(a.about), frozenset(t.about)), len(keys & about) / len(keys) if keys and about else 0.0)
    changed = "SUPERSEDES" if update else "CONTRADICTS"
    contained = a.value_id in t.value_id or t.value_id in a.value_id
    if s < 0.32:
        return "UNCERTAIN"
    if a.scope_id != t.scope_id:
        return "DIFFERENT_SCOPE"
    if unsure and not update:
        return "UNCERTAIN"
    if "NEUTRAL" not in (a.polarity, t.polarity) and a.polarity != t.polarity:
        return changed
    if a.value_id and t.value_id and a.value_id != t.value_id:
        if not contained:
            return changed
        if s >= 0.45:
            return "SUPERSEDES" if update else "REFINES"
    if update and s >= 0.45:
        return "SUPERSEDES"
    like = _jaccard(frozenset(a.terms), frozenset(t.terms))
    if like >= 0.82:
        return "SAME"
    return "REFINES" if (t.ident in a.ident or like >= 0.58) and len(a.ident) > len(t.ident) else "UNCERTAIN"


class _Active:
    """Active truths of one project and kind by how many terms they are about, and by each of these: a statement meets only truths that share one of its rarer terms."""

    def __init__(self):
        self.truths, self.turn, self.by_size, self.turns = {}, {}, {}, 0

    def put(self, a) -> int | None:
        """Makes a truth active and gives its turn; none where it was active, as the same statement again keeps its turn."""
        known = a.truth_id in self.truths
        if known:
            turn = self.turn[a.truth_id]
            self.drop(a.truth_id)
        else:
            self.turns = turn = self.turns + 1
        about = frozenset(a.about)
        self.truths[a.truth_id], self.turn[a.truth_id] = (a, about), turn
        own = self.by_size.setdefault(len(about), {})
        for term in about:
            own.setdefault(term, {})[a.truth_id] = None
        return None if known else turn

    def drop(self, truth_id: str) -> None:
        _, about = self.truths.pop(truth_id)
        own = self.by_size[len(about)]
        for term in about:
            del own[term][truth_id]
            if not own[term]:
                del own[term]
        del self.turn[truth_id]

    def best(self, a, least: float):
        """The truth most like a statement by what both are about, from `least` on; of equal ones the earliest."""
        about, found, best = frozenset(a.about), None, (least, -math.inf)
        n = len(about)
        for size, own in self.by_size.items():
            shared = math.ceil(least / (1 + least) * (n + size) - 1e-9)  # terms that two of such sizes share at least, to be that much alike
            if not 0 < shared <= min(n, size):
                continue
            # so one of the others, the rarer ones, is shared
            rarer = sorted((own[t] for t in about if t in own), key=len)
            rarer = rarer[: max(0, n - shared + 1 - (n - len(rarer)))]
            for truth_id in dict.fromkeys(t for ids in rarer for t in ids):
                t, terms = self.truths[truth_id]
                if (a.exact or t.exact) and a.subject_id != t.subject_id:
                    continue
                like = _jaccard(about, terms), -self.turn[truth_id]
                if like[0] >= least and (found is None or like > best):
                    found, best = t, like
        return found


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Statements in order, a project's kind after the other: each meets the active truths that earlier ones left."""
    key, active, order = None, _Active(), 0
    for frame in frames:
        out = []
        for a in frame.itertuples(index=False):
            if (a.project_id, a.kind) != key:
                key, active, order = (a.project_id, a.kind), _Active(), 0
            if not pd.isna(a.turn):  # active before this batch
                active.put(a)
                continue
            match = active.best(a, LEAST_LIKE)
            relation, status = "NEW", "CURRENT"
            if match is not None:
                relation = _decide(a, match, a.update, a.unsure)
                status = {"CONTRADICTS": "CONFLICTING", "UNCERTAIN": "PENDING_REVIEW", "SAME": "HISTORICAL"}.get(relation, "CURRENT")
                old = {"CONTRADICTS": "CONFLICTING", "SUPERSEDES": "SUPERSEDED", "REFINES": "SUPERSEDED"}.get(relation)
                if old:
                    out.append((match.truth_id, order := order + 1, *[None] * 10, old, "CONTRADICTS" if old == "CONFLICTING" else None, None, None, -1 if old == "SUPERSEDED" else None))
                if old == "SUPERSEDED":
                    active.drop(match.truth_id)
            replaced = match.truth_id if relation in ("SUPERSEDES", "REFINES") else None
            turn = active.put(a) if status in R.ACTIVE else None
            out.append((a.truth_id, order := order + 1, a.project_id, a.kind, a.conv_id, a.atom_id, a.text, a.subject, a.value, a.polarity, a.scope, a.confidence, status, relation, match.truth_id if match is not None else None, replaced, turn))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOLDED.split(", ")])


def truth_features(atoms: DataFrame) -> DataFrame:
    """Statements that may become truths, with what a decision needs, computed by columns."""
    a = truth_candidates(atoms)
    ident = T.normalize_identity(F.col("text"))
    keys = F.array_distinct(F.slice(F.filter(F.transform("keywords", lambda k: T.normalize_identity(k)), lambda k: F.length(k) >= 3), 1, 6))
    features = a.select(
        "project_id", "kind", F.when(F.col("conv_id").cast("string") != "", F.col("conv_id")).alias("conv_id"), "sequence", "index", "atom_id", "text", "subject", "value", "polarity", "scope", "confidence",
        T.normalize_identity(F.col("subject")).alias("subject_id"), ident.alias("ident"), T.terms(F.coalesce("subject", "text")).alias("about"), F.slice(T.terms(ident), 1, 18).alias("terms"), keys.alias("keys"),
        T.normalize_identity(F.col("value")).alias("value_id"), T.normalize_identity(F.col("scope")).alias("scope_id"), R.has(ident, R.UPDATE_CUE).alias("update"), R.has(ident, R.UNSURE_CUE).alias("unsure"),
        F.col("family").isin("explicit_qa_selection", "corroborated_exact_config").alias("exact"),
    ).where("subject_id <> ''")
    return features.withColumn("truth_id", T.canonical_id("truth", VERSION, F.col("project_id"), F.col("kind"), F.col("subject_id"), F.col("atom_id")))


def fold_step(features: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """What statements write, in order (ord): truths they make and changes of those they meet. `active`, of earlier steps, has features with batch and turn.

    A project's statements of one kind are judged in order, each against the truths that are active then, so one task streams them, sorted, and holds
    active truths alone. turn is positive where a truth becomes active and -1 where it ends.
    """
    none = F.lit(None).cast("bigint")
    rows = features.withColumns({"batch": none, "turn": none})
    if active is not None:
        touched = features.select("project_id", "kind").distinct()
        rows = rows.unionByName(active.join(touched, ["project_id", "kind"], "left_semi"))
    rows = rows.repartition("project_id", "kind").withColumn("fresh", F.col("turn").isNull())
    return rows.sortWithinPartitions("project_id", "kind", "fresh", "batch", "turn", "conv_id", "sequence", "index", "atom_id").mapInPandas(_folded, _FOLDED)


def still_active(features: DataFrame, writes: DataFrame, batch: int, active: DataFrame | None = None) -> DataFrame:
    """The active truths after a step, for the next one."""
    last = writes.where("turn is not null").groupBy("truth_id").agg(F.max_by("turn", "ord").alias("turn"))
    new = features.dropDuplicates(["truth_id"]).join(last.where("turn > 0"), "truth_id").withColumn("batch", F.lit(batch).cast("bigint"))
    return new if active is None else active.join(last, "truth_id", "left_anti").unionByName(new)


def truths_of(writes: DataFrame, order=None) -> DataFrame:
    """One row per truth from all that was written about it, the last by `order` counting."""
    order = F.col("ord") if order is None else order
    made = [F.max(c).alias(c) for c in ("project_id", "kind", "conv_id", "atom_id", "text", "subject", "value", "polarity", "scope", "confidence", "related", "supersedes")]  # one write alone has them
    return writes.groupBy("truth_id").agg(*made, F.max_by("status", order).alias("status"), F.max_by("relation", F.when(F.col("relation").isNotNull(), order)).alias("relation"))


def fold_truths(atoms: DataFrame) -> DataFrame:
    """One row per truth: what it says, its last status and relation, the truth it met and the one it replaces.

    An empty table has no truths; repeated statements are truths of their own, the later ones HISTORICAL. `streaming.truths` folds the same a batch at a time.
    """
    return truths_of(fold_step(truth_features(atoms)))


def block_records(rows: DataFrame, atoms: DataFrame, size: int = 250) -> DataFrame:
    """Blocks of `size` consecutive messages with their bounds, length, messages, atoms in the order of the text, id and hash: the hash is that of the block's fields as JSON with keys in order. A block without atoms has none."""
    c = F.col
    block = F.floor(c("sequence") / size)
    ids = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda r: r["id"])
    message = F.struct("sequence", T.canonical_id("msg", VERSION, c("conv_id").cast("string"), c("sequence").cast("string")).alias("id"))
    own = rows.groupBy("conv_id", block.alias("block")).agg(F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"), F.sum(F.length("text")).alias("n_chars"), ids(message).alias("messages"))
    said = atoms.groupBy("conv_id", block.alias("block")).agg(ids(F.struct("sequence", "index", c("atom_id").alias("id"))).alias("atoms"))
    out = own.join(said, ["conv_id", "block"], "left").withColumn("atoms", F.coalesce("atoms", F.array().cast("array<string>")))
    fields = F.struct(c("atoms").alias("atomIds"), c("block").alias("blockNumber"), c("conv_id").cast("string").alias("conversationId"), c("first_sequence").alias("firstSequence"), c("last_sequence").alias("lastSequence"), c("messages").alias("messageIds"))
    return out.withColumns({"block_id": T.canonical_id("evidence-block", VERSION, c("conv_id").cast("string"), c("block").cast("string")), "hash": F.sha2(F.to_json(fields).cast("binary"), 256)})


def pairs_in_turn(atoms: DataFrame) -> DataFrame:
    """Each statement and the one before it in its conversation, with their relation."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("sequence", "index")
    before = F.lag(F.struct("conv_id", "atom_id", "text", "subject", "value", "polarity", "scope")).over(w)
    both = atoms.withColumn("t", before).where("t is not null")
    column = lambda p: {c: F.col(f"{p}{c}") for c in ("conv_id", "text", "subject", "value", "polarity", "scope")}
    return both.select("atom_id", F.col("t.atom_id").alias("truth_id"), R.relation(column("") | {"keywords": F.col("keywords")}, column("t.")).alias("relation"))


def truth_root(truths: DataFrame) -> DataFrame:
    """Top hash of the tree of CURRENT truths (see records.set_root)."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("truth_id", "text", "kind", "confidence", "subject", "value", "polarity", "scope")]
    return records.set_root(truths.where("status = 'CURRENT'").select(F.sha2(F.concat_ws(T.SEPARATOR, *fields).cast("binary"), 256).alias("h")))


def _evidence(rows: DataFrame, columns: list[str]) -> DataFrame:
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return rows.select(F.sha2(F.concat_ws(T.SEPARATOR, *fields).cast("binary"), 256).alias("h"))


def evidence_tree(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Tree of hashes of messages by the named columns (see records.hash_tree)."""
    return records.hash_tree(_evidence(rows, columns))


def evidence_root(rows: DataFrame, columns: list[str]) -> DataFrame:
    return records.set_root(_evidence(rows, columns))


def missing_citations(cited: DataFrame, known: DataFrame, allowed: DataFrame, key: str = "id") -> DataFrame:
    """Cited ids that are not known (missing) or not among the allowed ones (outside); one row for each and its reason."""
    ids = cited.select(key).where(F.col(key).isNotNull()).distinct()
    missing = ids.join(known.select(key), key, "left_anti").withColumn("reason", F.lit("missing"))
    return missing.union(ids.join(allowed.select(key), key, "left_anti").withColumn("reason", F.lit("outside")))
