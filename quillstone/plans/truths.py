"""Queries on statements, their rules and truths, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import conversations as C
from ..operators import truths as U
from .reference import _ATOMS, _LOW, _MESSAGES, _NORM, _SENTENCES, ORACLES, QUERIES, query, tree

WITH = f"with {_MESSAGES}, {_SENTENCES}, {_ATOMS}"


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '(?i){pattern.replace(chr(39), chr(39) * 2)}')"


def parts(c: str) -> str:
    return f"len(string_split({c}, ' '))"


def ident(c: str) -> str:
    return f"lower({_NORM.replace('text', f'''coalesce({c}::varchar, '')''', 1)})"


def terms(c: str) -> str:
    """Distinct terms of three characters or more, in order."""
    words = f"list_filter(regexp_split_to_array({_LOW.format(c)}, '[^a-z0-9]+'), lambda x: length(x) >= 3)"
    return f"list_filter({words}, lambda x, i: list_position({words}, x) = i)"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"case when len({a}) + len({b}) > 0 then {both} / (len({a}) + len({b}) - {both})::double else 0.0::double end"


_ASKS = f"({rx('sentence', R.CHAT_TASK)} and not {rx('sentence', R.PROJECT_REQUIREMENT)})"
FAMILIES = [
    ("assistant_or_unknown_author", "RESIDUAL", 0, 1, "role not in ('user', 'human')"), ("empty_candidate", "RESIDUAL", 0, 1, "sentence = ''"), ("code_or_log", "RESIDUAL", 0, 1, rx("sentence", R.CODE_OR_LOG)),
    ("question", "RESIDUAL", 0, 1, rx("sentence", R.QUESTION)), ("chat_task", "RESIDUAL", 0, 1, _ASKS), ("transient_observation", "RESIDUAL", 0, 1, rx("sentence", R.TRANSIENT)),
    ("speculation", "RESIDUAL", 0, 0, f"({rx('sentence', R.SPECULATIVE)} or kind = 'hypothesis')"), ("explicit_negative_constraint", "D0", 1, 0, rx("sentence", R.NEGATIVE_CONSTRAINT)),
    ("explicit_first_person_requirement", "D0", 1, 0, rx("sentence", R.FIRST_PERSON)), ("explicit_project_config", "D1", 1, 0, rx("sentence", R.CONFIG)),
    ("bounded_project_requirement", "D1", 1, 0, rx("sentence", R.PROJECT_REQUIREMENT)), ("calibrated_short_component_directive", "D2", 1, 0, f"({rx('sentence', R.SHORT_DIRECTIVE)} and {parts('sentence')} >= 3)"),
]
_FAMILY = "case " + " ".join(f"when {c} then '{f}'" for f, _, _, _, c in FAMILIES) + " else 'residual' end"
_among = lambda i: "family in (" + ", ".join(f"'{f[0]}'" for f in FAMILIES if f[i]) + ")"
_TIER = "case " + " ".join(f"when family = '{f}' then '{t}'" for f, t, _, _, _ in FAMILIES) + " else 'RESIDUAL' end"
_SURE = (
    f"round(0.42::double + case when length(subject) >= 3 then 0.16::double else 0 end + case when trim(coalesce(value, '')) <> '' then 0.12::double else 0 end + case when {parts('sentence')} >= 6 then 0.08::double else 0 end"
    f" + case when {parts('sentence')} >= 12 then 0.06::double else 0 end + 0.08::double + case when {rx('sentence', R.SEQUENCE_CUE)} then 0.04::double else 0 end - case when {parts('sentence')} < 4 then 0.2::double else 0 end, 9)"
)
#: All columns of atoms but places.
FULL = f"""full_atoms as (
  select 'atom_' || substr(sha256(concat_ws(chr(9247), '1', message_id, idx::varchar, lower(sentence))), 1, 24) as atom_id, *, {_TIER} as tier, {_among(2)} as eligible, {_among(3)} as blocked from (
    select *, 'p' || (conv_id % 7) as project_id, 'msg_' || substr(sha256(concat_ws(chr(9247), '1', conv_id::varchar, sequence::varchar)), 1, 24) as message_id, {_FAMILY} as family, {_SURE} as confidence from atoms))"""

# fn_atomize of all columns takes the place of the shorter one
ORACLES["fn_atomize"] = f"""{WITH}, {FULL}, p as (
  select conv_id, sequence, unnest(string_split(regexp_replace({_NORM}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1))) as s, generate_subscripts(string_split(regexp_replace({_NORM}, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)), 1) as i from messages
), o as (select *, sum(length(s) + 1) over (partition by conv_id, sequence order by i) - length(s) - 1 as start from p
), q as (select conv_id, sequence, row_number() over (partition by conv_id, sequence order by i) - 1 as idx, start from o where length(s) >= 4)
select atom_id, project_id, conv_id, message_id, sequence, role, idx as "index", sentence as text, kind, subject, value, null::varchar as scope, polarity, keywords, confidence, cast(coalesce(start, 0) as bigint) as source_start,
  cast(coalesce(start, 0) + length(sentence) as bigint) as source_end, family, tier, eligible, blocked, 'strict_truth:' || family || ' ' || case when eligible then 'strict_truth:eligible' else 'strict_truth:residual' end as rule_trace
from full_atoms left join q using (conv_id, sequence, idx)"""


@query("conversations", sql=ORACLES["fn_atomize"])
def fn_atomize(conversations):
    return U.atomize(conversations).withColumns({"keywords": F.array_join("keywords", " "), "rule_trace": F.array_join("rule_trace", " "), "source_start": F.col("source_start").cast("bigint"), "source_end": F.col("source_end").cast("bigint")})


@query("conversations", sql=f"{WITH}, {FULL} select family, tier, eligible, blocked, count(*) as n from full_atoms group by all")
def fn_strict_rule(conversations):
    return U.atomize(conversations).groupBy("family", "tier", "eligible", "blocked").agg(F.count("*").alias("n"))


@query("conversations", sql=f"{WITH}, {FULL} select atom_id, confidence from full_atoms")
def fn_sufficiency_intrinsic(conversations):
    return U.atomize(conversations).select("atom_id", "confidence")


@query("conversations", sql=ORACLES["fn_atomize"].replace("select atom_id, project_id", "select atom_id, source_start, source_end from (select atom_id, project_id", 1) + ")")
def win_atom_cursor(conversations):
    return U.atomize(conversations).select("atom_id", F.col("source_start").cast("bigint").alias("source_start"), F.col("source_end").cast("bigint").alias("source_end"))


@query("conversations", sql=f"{WITH}, {FULL} select atom_id, project_id, kind from full_atoms where not blocked and role = 'user' and kind in ('decision', 'constraint', 'fact', 'task')")
def flt_strict_blocked(conversations):
    return U.truth_candidates(U.atomize(conversations)).select("atom_id", "project_id", "kind")


_ROOT = f"family || ':' || kind || ':' || {ident('subject')} || ':' || {ident('value')} || ':' || polarity || ':'"


@query("conversations", sql=f"{WITH}, {FULL} select atom_id, family as rule, {_ROOT} as root_key, split_part({_ROOT}, ':', 1) as from_root from full_atoms")
def fn_rule_from_record(conversations):
    nothing = F.lit(None).cast("string")
    a = U.atomize(conversations).withColumn("rule", R.rule_of(nothing, F.col("rule_trace"), nothing))
    a = a.withColumn("rule", F.coalesce("rule", F.lit("residual"))).withColumn("root_key", R.root_key(F.col("rule"), F.col("kind"), F.col("subject"), F.col("value"), F.col("polarity"), F.col("scope")))
    return a.select("atom_id", "rule", "root_key", R.rule_of(nothing, F.array().cast("array<string>"), F.col("root_key")).alias("from_root"))


_PAIRS = f"""{WITH}, {FULL}, f as (
  select atom_id, conv_id, sequence, idx, {ident('sentence')} as ident, {terms("coalesce(subject, sentence, '')")} as about, {terms('lower(sentence)')} as ts, list_filter(string_split(keywords, ' '), lambda x: length(x) >= 3)[1:6] as ks,
    {ident('value')} as val, polarity, {rx('lower(sentence)', R.UPDATE_CUE)} as upd, {rx('lower(sentence)', R.UNSURE_CUE)} as unsure from full_atoms
), p as (select f.*, t.atom_id as truth_id, t.ident as ident2, t.about as about2, t.ts as ts2, t.val as val2, t.polarity as polarity2 from (select *, lag(atom_id) over (partition by conv_id order by sequence, idx) as before from f) f join f t on t.atom_id = f.before
), sc as (select *, greatest({jaccard('about', 'about2')}, case when len(ks) > 0 and len(ts2) > 0 then len(list_intersect(ks, ts2[1:10])) / len(list_distinct(ks))::double else 0.0::double end) as s, {jaccard('ts[1:18]', 'ts2[1:18]')} as sim,
    case when val <> '' and val2 <> '' then case when val = val2 then 'SAME' when contains(val, val2) or contains(val2, val) then 'REFINES' else 'CONFLICTS' end else 'NONE' end as vr, case when upd then 'SUPERSEDES' else 'CONTRADICTS' end as chg from p)
select atom_id, truth_id, case when ident = ident2 then 'SAME' when s < 0.32 then 'UNCERTAIN' when unsure and not upd then 'UNCERTAIN' when polarity <> 'NEUTRAL' and polarity2 <> 'NEUTRAL' and polarity <> polarity2 then chg when vr = 'CONFLICTS' then chg
  when vr = 'REFINES' and s >= 0.45 then case when upd then 'SUPERSEDES' else 'REFINES' end when upd and s >= 0.45 then 'SUPERSEDES' when sim >= 0.82 then 'SAME' when (contains(ident, ident2) or sim >= 0.58) and length(ident) > length(ident2) then 'REFINES' else 'UNCERTAIN' end as relation from sc"""


@query("conversations", sql=_PAIRS)
def fn_relation(conversations):
    """Every statement against the one before it in its conversation."""
    return U.pairs_in_turn(U.atomize(conversations))


@query("conversations", sql=f"""{WITH}, {FULL}, p as (select atom_id, {ident('value')} as a, lag({ident('value')}) over (partition by conv_id order by sequence, idx) as b, subject, lag(subject) over (partition by conv_id order by sequence, idx) as s2 from full_atoms)
select atom_id, case when a = b then 'SAME' when contains(a, b) or contains(b, a) then 'REFINES' else 'CONFLICTS' end as relation, {ident('subject')} = {ident('s2')} as compatible from p where a <> '' and b <> ''""")  # fmt: skip
def fn_value_relationship(conversations):
    """Values of neighbouring statements; compatible: whether two exact families would go together."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("sequence", "index")
    a = U.atomize(conversations).select("atom_id", T.normalize_identity(F.col("value")).alias("a"), F.lag(T.normalize_identity(F.col("value"))).over(w).alias("b"), "subject", F.lag("subject").over(w).alias("s2"))
    exact = F.lit("explicit_qa_selection")
    return a.where("a <> '' and b <> ''").select("atom_id", R.value_relationship(F.col("a"), F.col("b")).alias("relation"), R.family_compatible(exact, F.col("subject"), exact, F.col("s2")).alias("compatible"))


QUERIES["q_truth_fold"] = lambda spark, sf: U.fold_truths(U.atomize(spark.read.parquet(f"{sf}/conversations.parquet")))
QUERIES["agg_truth_root"] = lambda spark, sf: U.truth_root(QUERIES["q_truth_fold"](spark, sf))

QUERIES["join_truth_match"] = lambda spark, sf: QUERIES["q_truth_fold"](spark, sf).where("related is not null").select("truth_id", "related", "relation")


_IDS = lambda c: f"coalesce(array_to_string({c}, ','), '')"
_QUOTED = lambda c: "'[' || coalesce(array_to_string(list_transform(" + c + ", lambda x: chr(34) || x || chr(34)), ','), '') || ']'"
_JSON = f"""'{{"atomIds":' || {_QUOTED('atoms')} || ',"blockNumber":' || block || ',"conversationId":"' || conv_id || '","firstSequence":' || first_sequence || ',"lastSequence":' || last_sequence || ',"messageIds":' || {_QUOTED('messages')} || '}}'"""


# blocks with their atoms and hashes take the place of the shorter ones
@query("conversations", sql=f"""{WITH}, {FULL}, bm as (select conv_id, sequence // 250 as block, min(sequence) as first_sequence, max(sequence) as last_sequence, sum(length(text))::bigint as n_chars, list('msg_' || substr(sha256(concat_ws(chr(9247), '1', conv_id::varchar, sequence::varchar)), 1, 24) order by sequence) as messages from messages group by 1, 2),
ba as (select conv_id, sequence // 250 as block, list(atom_id order by sequence, idx) as atoms from full_atoms group by 1, 2)
select conv_id, block, first_sequence, last_sequence, n_chars, {_IDS('messages')} as messages, {_IDS('atoms')} as atoms, 'evidence-block_' || substr(sha256(concat_ws(chr(9247), '1', conv_id::varchar, block::varchar)), 1, 24) as block_id, sha256({_JSON}) as hash from bm left join ba using (conv_id, block)""")  # fmt: skip
def agg_evidence_block(conversations):
    rows = U.block_records(C.messages(conversations), U.atomize(conversations))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("messages", "atoms")})


_EVIDENCE = f"with {_MESSAGES}, " + tree("(select distinct sha256(concat_ws(chr(9247), conv_id::varchar, sequence::varchar, role, text)) as h from messages)")


@query("conversations", sql=f"{_EVIDENCE} " + " union all ".join(f"select prefix, n, hash from n{d}" for d in range(5)))
def agg_evidence_tree(conversations):
    """All nodes of the tree of messages: what two replicas compare, from the root down."""
    return U.evidence_tree(C.messages(conversations), ["conv_id", "sequence", "role", "text"])


@query("conversations", sql=f"{_EVIDENCE} select max(hash) as root from n0")
def agg_evidence_root(conversations):
    return U.evidence_root(C.messages(conversations), ["conv_id", "sequence", "role", "text"])


@query("conversations", sql=f"""{WITH}, {FULL}, c as (select atom_id as id from full_atoms where "sequence" < 3 union select 'none_' || conv_id from full_atoms)
select id, 'missing' as reason from c where id not in (select atom_id from full_atoms) union all select id, 'outside' as reason from c where id not in (select atom_id from full_atoms where eligible)""")  # fmt: skip
def join_citation_check(conversations):
    """Cited statements against all of them, and against those that are strictly eligible."""
    a = U.atomize(conversations).select(F.col("atom_id").alias("id"), "conv_id", "sequence", "eligible")
    cited = a.where("sequence < 3").select("id").union(a.select(F.concat(F.lit("none_"), F.col("conv_id").cast("string")).alias("id")))
    return U.missing_citations(cited, a, a.where("eligible"))
