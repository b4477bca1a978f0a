"""Queries on exports, digests, projects, runs and change logs, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations as C
from ..operators import digest as D
from ..operators import postings as I
from ..operators import projects as P
from ..operators import records as R
from ..operators import truths as U
from ..sources import exports as X
from .projection import _T, tables
from .reference import _LOW, _MESSAGES, _NORM, _WORDS, ORACLES, QUERIES, query
from .truths import FULL, WITH, jaccard

# --- exports: conversations written as files of four shapes, and read back


def files(conversations) -> DataFrame:
    """(name, content): each conversation as a file, of a provider's shape by its id."""
    m = C.messages(conversations).withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("sequence").cast("string")))
    c, text = F.col, F.col("text")
    item = F.struct("sequence", F.struct(c("id").alias("uuid"), c("role").alias("sender"), "text").alias("a"), F.struct("id", "role", F.array(F.struct("text")).alias("parts")).alias("b"),
                    F.struct(c("id").alias("externalId"), "sequence", "role", "text").alias("d"), F.lpad(c("sequence").cast("string"), 6, "0").alias("key"),
                    F.struct(F.struct("id", F.struct("role").alias("author"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message")).alias("e"))
    own = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(item), lambda x, y: x["sequence"] - y["sequence"]).alias("x")).withColumn("cid", c("conv_id").cast("string"))
    get = lambda k: F.transform("x", lambda i: i[k])
    claude = F.to_json(F.array(F.struct(c("cid").alias("uuid"), F.lit("t").alias("name"), get("a").alias("chat_messages"))))
    gemini = F.to_json(F.struct(F.array(F.struct(c("cid").alias("id"), F.lit("t").alias("title"), get("b").alias("messages"))).alias("conversations")))
    mapping = F.to_json(F.array(F.struct(c("cid").alias("id"), F.lit("t").alias("title"), F.map_from_entries(F.transform("x", lambda i: F.struct(i["key"], i["e"]))).alias("mapping"))))
    envelope = F.to_json(F.struct(F.lit("SOURCE_ENVELOPE").alias("format"), F.lit(2).alias("version"), F.lit("Microsoft").alias("provider"), c("cid").alias("conversationExternalId"), F.lit("t").alias("conversationTitle"), get("d").alias("messages")))
    shape = c("conv_id") % 4
    content = F.when(shape == 0, claude).when(shape == 1, gemini).when(shape == 2, mapping).otherwise(envelope)
    return own.select(F.concat(F.element_at(F.array(*map(F.lit, ("a", "gemini", "c", "d"))), (shape + 1).cast("int")), c("cid"), F.lit(".json")).alias("name"), content.alias("content"))


_PROVIDER = "case conv_id % 4 when 0 then 'claude' when 1 then 'gemini' when 2 then 'chatgpt' else 'copilot' end"
_ID = "conv_id || '-' || sequence"


@query("conversations", sql=f"with {_MESSAGES} select {_PROVIDER} as provider, conv_id::varchar as conversation_id, sequence, role, trim(text) as text, {_ID} as message_id from messages")
def src_json_export(conversations):
    return X.normalised(files(conversations)).select("provider", "conversation_id", "sequence", "role", "text", "message_id")


@query("conversations", sql=f"with {_MESSAGES} select distinct {_PROVIDER} as provider, conv_id::varchar as conversation_id, 't' as title from messages")
def src_root_dispatch(conversations):
    """Conversations of lists, objects with a list, mappings and envelopes."""
    return X.normalised(files(conversations)).select("provider", "conversation_id", "title").distinct()


@query("conversations", sql=f"with {_MESSAGES} select distinct conv_id::varchar as id, conv_id % 4 in (0, 2) as listed, conv_id % 4 = 2 as mapped from messages")
def src_shape_sniff(conversations):
    head = F.substring("content", 1, 512 * 1024)
    return files(conversations).select(F.regexp_extract("name", r"(\d+)\.json$", 1).alias("id"), X.is_array(F.col("content")).alias("listed"), (head.contains('"mapping"') & head.contains('"message"')).alias("mapped"))


@query("conversations", sql=f"with {_MESSAGES} select {_ID} as message_id, conv_id::varchar as conversation_id from messages")
def fn_message_id(conversations):
    return X.normalised(files(conversations)).select("message_id", "conversation_id")


_has = lambda *ps: " or ".join(f"contains(lower(name), '{p}')" for p in ps)


@query("documents", "conversations", sql=f"""select name, n, case when {_has('chatgpt')} or lower(name) = 'openai' then 'chatgpt' when {_has('claude', 'anthropic')} then 'claude' when {_has('gemini', 'bard')} or lower(name) = 'google' then 'gemini' when {_has('copilot', 'bing')} or lower(name) = 'microsoft' then 'copilot'
  when {_has('poe')} then 'poe' when {_has('perplexity')} then 'perplexity' when name = '' then 'generic' else regexp_replace(lower(name), '[^a-z0-9_-]+', '_', 'g') end as provider,
  case when {_has('claude', 'anthropic')} then 'claude' when {_has('gemini', 'bard')} then 'gemini' when {_has('copilot', 'bing')} then 'copilot' when {_has('poe')} then 'poe' when {_has('perplexity')} then 'perplexity' when {_has('chatgpt', 'openai')} then 'chatgpt' end as hint
  from (select name, count(*) as n from (select trim(source) as name from documents where source is not null union all select trim(role) from conversations where role is not null) group by 1)""")  # fmt: skip
def fn_provider(docs, conversations):
    """The providers that sources of documents and roles of messages name; names of every kind are in the tests."""
    names = docs.select(F.trim("source").alias("name")).union(conversations.select(F.trim("role"))).where("name is not null").groupBy("name").agg(F.count("*").alias("n"))
    return names.select("name", "n", X.provider(F.col("name")).alias("provider"), X.provider_hint(F.col("name")).alias("hint"))


@query("conversations", sql=f"with {_MESSAGES} select conv_id, sequence, array_to_string(list_filter(regexp_split_to_array(lower({_NORM}), '[^a-z0-9]+'), lambda x: length(x) >= 4)[1:12], ' ') as keywords from messages")
def fn_keywords_title(conversations):
    """The first twelve words of four letters or digits at least, repeated ones too, of what is imported."""
    return C.messages(conversations).select("conv_id", "sequence", F.array_join(T.title_keywords(F.col("text")), " ").alias("keywords"))


# --- digests


@query("conversations", sql=rf"""with {_MESSAGES}, b as (select conv_id, sequence // 100 as part, sequence, '### ' || case role when 'user' then 'User' when 'assistant' then 'Assistant' when 'system' then 'System' when 'tool' then 'Tool' else upper(substr(role, 1, 1)) || substr(role, 2) end || chr(10) || chr(10) || regexp_replace(text, '(?m)^(#{{1,6}}) ', '##\1 ', 'g') || chr(10) as body from messages)
select conv_id, part, count(*) as n, 'topics/conversation_' || conv_id || '_' || lpad((part + 1)::varchar, 3, '0') || '.md' as path, '# conversation ' || conv_id || chr(10) || chr(10) || string_agg(body, chr(10) order by sequence) as content from b group by conv_id, part""")  # fmt: skip
def snk_digest_md(conversations):
    return D.parts(C.messages(conversations))


@query("conversations", sql=f"{WITH} select (select count(*) from messages) as paragraphs, (select count(distinct conv_id) from messages) as threads, (select count(*) from atoms) as atoms")
def snk_digest_summary(conversations):
    return D.summary(C.messages(conversations), U.atomize(conversations))


@query("conversations", sql=f"with {_MESSAGES} select count(distinct conv_id) as conversations, count(*) as messages from messages")
def snk_summary_fallback(conversations):
    return C.messages(conversations).agg(F.count_distinct("conv_id").alias("conversations"), F.count("*").alias("messages"))


@query("conversations", sql=f"""{WITH}, n as (select conv_id, count(*) as atoms from atoms group by 1), c as (select conv_id, count(*) as m from messages group by 1), p as (select conv_id, sequence // 3 as part, count(*) as n_messages from messages group by 1, 2)
select conv_id, part, n_messages, coalesce(atoms, 0) as atoms, cast(ceil(coalesce(atoms, 0) * n_messages / m::double) as bigint) as part_atoms from p join c using (conv_id) left join n using (conv_id)""")  # fmt: skip
def agg_thread_atoms(conversations):
    return D.thread_atoms(C.messages(conversations), U.atomize(conversations))


@query("pages", sql=r"select page_id, regexp_replace(url, '([\\`*_\[\]<>#|])', '\\\1', 'g') as escaped, trim(regexp_replace(replace(url, '|', '\|'), '[\r\n]+', ' ', 'g')) as cell, case when f = '' then 'conversation' else substr(f, 1, 64) end as file from (select *, regexp_replace(regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as f from pages)")
def fn_md(pages):
    c = F.col("url")
    return pages.select("page_id", D.escaped(c).alias("escaped"), D.cell(c).alias("cell"), D.file_name(c).alias("file"))


@query("orders", sql="select o_orderkey, case when n < 1024 then n || ' B' when n < 1048576 then (((n * 10 + 512) // 1024) // 10) || '.' || (((n * 10 + 512) // 1024) % 10) || ' KB' else (((n * 10 + 524288) // 1048576) // 10) || '.' || (((n * 10 + 524288) // 1048576) % 10) || ' MB' end as size, case when n < 1000 then n || ' ms' when n // 1000 < 60 then ((n + 50) // 1000) || '.' || (((n + 50) // 100) % 10) || ' s' else (n // 60000) || ' m ' || ((n // 1000) % 60) || ' s' end as took from (select o_orderkey, o_orderkey * 37 as n from orders)")
def fn_format(orders):
    n = F.col("o_orderkey") * 37
    return orders.select("o_orderkey", D.bytes_text(n).alias("size"), D.duration_text(n).alias("took"))


@query("documents", sql="select source, case when sum(n_chars) > 0 then round((1 - cast(sum(length(coalesce(text, ''))) as double) / cast(sum(n_chars) * 2 as double)) * 100, 6) else 0.0::double end as saved from documents group by 1")
def agg_compression(docs):
    one = docs.groupBy("source").agg((F.sum("n_chars") * 2).cast("double").alias("b"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("a"))
    return one.select("source", D.compression(F.col("b"), F.col("a")).alias("saved"))


@query("pages", sql=r"select page_id, 'url=' || coalesce(url, '') || chr(10) || 'html=' || replace(replace(replace(replace(coalesce(html, ''), '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') as manifest from pages")
def snk_txt_manifest(pages):
    return D.manifest(pages, ["page_id", "url", "html"])


# --- projects and runs

_TOK = f"list_filter(regexp_split_to_array({_LOW.format(_NORM)}, '[^a-z0-9.+#-]+'), lambda x: length(x) >= 3 and not list_contains([{', '.join(f'{chr(39)}{w}{chr(39)}' for w in P.STOP)}], x))"
_NAME = f"list_filter(list_transform(regexp_extract_all({_NORM}, '{P.NAMES}'), lambda x: lower(x)), lambda x: length(x) >= 4)"
_WORDS2 = f"kw as (select conv_id, word, count(*) as n from (select conv_id, unnest({_TOK}) as word from (select conv_id, text from messages union all select conv_id, text from messages where role = 'user')) group by all), kr as (select *, row_number() over (partition by conv_id order by n desc, word) as rank from kw qualify rank <= 28)"
_NAMES2 = f"nw as (select conv_id, word, count(*) as n from (select conv_id, unnest({_NAME}) as word from messages) group by all), nr as (select *, row_number() over (partition by conv_id order by n desc, word) as rank from nw qualify rank <= 16)"
_PRINTS = f"with {_MESSAGES}, {_WORDS2}, {_NAMES2}, fp as (select conv_id, coalesce(content, []) as content, coalesce(names, []) as names from (select distinct conv_id from messages) left join (select conv_id, list(word order by rank) as content from kr group by 1) using (conv_id) left join (select conv_id, list(word order by rank) as names from nr group by 1) using (conv_id))"


@query("conversations", sql=f"with {_MESSAGES}, {_WORDS2} select conv_id, word, n, rank from kr")
def agg_keywords_topk(conversations):
    m = C.messages(conversations)
    twice = m.select("conv_id", "text").union(m.where("role = 'user'").select("conv_id", "text"))
    return P.top_words(twice, "conv_id", P.tokens(F.col("text")), 28)


@query("conversations", sql=f"with {_MESSAGES}, {_NAMES2} select conv_id, word, n, rank from nr")
def agg_entities_topk(conversations):
    return P.top_words(C.messages(conversations), "conv_id", P.names(F.col("text")), 16)


@query("conversations", sql=rf"with {_MESSAGES}, t as (select conv_id, sequence, case when sequence % 3 = 0 then 'Conversation ' || conv_id when sequence % 3 = 1 then 'New chat (2024-01-02)' else {_NORM} end as title from messages) select conv_id, sequence, t.title = '' or regexp_matches(regexp_replace(t.title, '\s*\(\d{{4}}-\d{{2}}-\d{{2}}\)$', ''), '{P.GENERIC}') as generic from t")
def fn_title_generic(conversations):
    s = F.col("sequence") % 3
    title = F.when(s == 0, F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))).when(s == 1, "New chat (2024-01-02)").otherwise(F.col("text"))
    return C.messages(conversations).select("conv_id", "sequence", P.generic_title(title).alias("generic"))


def projects(prints):
    """Every tenth conversation as a project of its first words and names."""
    return prints.where("conv_id % 10 = 0").select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("project_id"), F.slice("content", 1, 12).alias("terms"), F.slice("names", 1, 8).alias("names"))


_SCORED = f"""{_PRINTS}, pr as (select 'p' || conv_id as project_id, content[1:12] as terms, names[1:8] as pnames from fp where conv_id % 10 = 0), fa as (select *, list_distinct(list_concat(content, names)) as all_ from fp),
sp as (select conv_id, project_id, {jaccard('content[1:20]', 'terms')} as j, case when len(content) > 0 and len(terms) > 0 then len(list_intersect(content[1:12], terms)) / len(content[1:12])::double else 0 end as o, {jaccard('names', 'pnames')} as e, list_has_any(all_, pnames) as x, len(list_intersect(content, terms)) as shared
  from fa, pr where list_has_any(all_, list_concat(terms, pnames))), sr as (select conv_id, project_id, shared, round(least(greatest(0.46::double * greatest(j, o) + 0.18::double * e + 0.12::double * case when x then 1.0::double else 0 end, 0), 1), 9) as score from sp),
sm as (select *, row_number() over w as place, lead(score) over w as runner from sr window w as (partition by conv_id order by score desc, project_id)),
ma as (select conv_id, project_id, score, coalesce(score >= 0.14 and shared >= 3 and (runner is null or score >= runner + 0.08), false) as accepted from sm where place = 1)"""


@query("conversations", sql=f"{_SCORED} select conv_id, project_id, score, accepted from ma")
def join_project_match(conversations):
    prints = P.fingerprints(C.messages(conversations))
    return P.matched(P.project_scores(prints, projects(prints)))


@query("conversations", sql=f"""{_SCORED}, na as (select *, case when len(content) > 0 then array_to_string(list_transform(content[1:4], lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' · ') else 'Unresolved conversation' end as nm, array_to_string(list_sort(list_concat(content[1:12], names[1:8])), '|') as k from fa)
select conv_id, coalesce(m.project_id, 'proj_' || substr(sha256(concat_ws(chr(9247), '1', 'project', lower(case when k = '' then nm else k end))), 1, 24)) as project_id, case when m.project_id is null then nm end as new_name, coalesce(score, case when len(all_) >= 4 then 0.82::double else 0.62::double end) as confidence
from na left join (select * from ma where accepted) m using (conv_id)""")  # fmt: skip
def q_project_resolve(conversations):
    prints = P.fingerprints(C.messages(conversations))
    return P.resolved(prints, projects(prints))


_TERMS8 = f"list_filter(regexp_split_to_array({_LOW.format('sentence')}, '[^a-z0-9]+'), lambda x: length(x) >= 3)"
_KEY = f"substr(case when len({_TERMS8}) > 0 then array_to_string(list_sort(list_filter({_TERMS8}, lambda x, i: list_position({_TERMS8}, x) = i)[1:8]), ' ') else lower(sentence) end, 1, 160)"


@query("conversations", sql=f"{WITH}, {FULL} select atom_id, {_KEY} as key from full_atoms")
def fn_trajectory_key(conversations):
    return U.atomize(conversations).select("atom_id", P.trajectory_key(F.col("text")).alias("key"))


def runs(conversations):
    """Statements as tasks of runs, their ends by place."""
    i = F.col("index")
    stages = F.when(i % 4 == 0, F.array(F.lit("BRANCH_ZERO"))).when(i % 4 == 1, F.array(F.lit("TINY_SPECIALIST"))).when(i % 4 == 2, F.array(F.lit("HARD_RESIDUAL"), F.lit("MODEL_LOCAL"))).otherwise(F.array(F.lit("HARD_RESIDUAL"), F.lit("RESIDUAL_REPAIR")))
    status = F.when(F.col("sequence") % 5 == 4, "BLOCKED_EXTERNAL_DEPENDENCY").when(F.col("sequence") % 5 == 3, "FAILED").otherwise("SOLVED")
    return U.atomize(conversations).select(F.col("atom_id").alias("run_id"), (F.col("sequence") * 1000 + i).alias("at"), F.concat(F.lit("sum up "), F.substring("subject", 1, 3)).alias("task"), "project_id", status.alias("status"), stages.alias("stages"), (i % 3).alias("n_evidence"))


@query("conversations", sql=f"""{WITH}, {FULL}, ru as (select atom_id as run_id, sequence * 1000 + idx as at_, 'sum up ' || substr(subject, 1, 3) as sentence, project_id, case when sequence % 5 = 4 then 'PENDING' when sequence % 5 = 3 then 'FAIL' else 'PASS' end as verification,
  case idx % 4 when 0 then 'BRANCH_ZERO' when 1 then 'TINY_SPECIALIST' when 2 then 'MRS_MODEL' else 'REPAIR' end as ended_by, idx % 4 = 2 as model, idx % 3 as n_evidence from full_atoms), rk as (select *, {_KEY} as key, case when verification = 'PASS' then 'SUCCESS' when ended_by = 'REPAIR' then 'REPAIR' else 'FAILURE' end as outcome, verification = 'PASS' and n_evidence > 0 as good from ru),
rv as (select *, row_number() over w as v, lag(run_id) over w as rb from rk window w as (partition by key, project_id, good order by at_, run_id))
select run_id, key, project_id, verification, outcome, ended_by, case when good then v end as version, case when good then rb end as rollback, case when good then case when not model and v >= 2 then 'VERIFIED' when not model then 'REPLAY_VERIFIED' else 'CANDIDATE' end end as state from rv""")  # fmt: skip
def q_compile(conversations):
    return P.compiled(runs(conversations)).withColumn("version", F.col("version").cast("bigint"))


@query("conversations", sql=f"""{WITH}, {FULL}, jobs as (select 'job' || conv_id as job_id, list(atom_id) filter (sequence < 2) as allowed from full_atoms group by conv_id), res as (select 'job' || case when conv_id % 9 = 8 then -1 else conv_id end as job_id, conv_id as result_id, list(distinct cited) as cited from (
  select conv_id, atom_id as cited from full_atoms where sequence < 1 + conv_id % 3 union all select conv_id, 'none' from full_atoms where conv_id % 5 = 4) group by 1, 2), ex as (select result_id, job_id, unnest(cited) as id from res),
ck as (select result_id, bool_or(j.job_id is null) as lost, count(*) filter (id not in (select atom_id from full_atoms)) as missing, count(*) filter (id in (select atom_id from full_atoms) and not coalesce(list_contains(j.allowed, id), false)) as outside, count(*) as cited from ex left join jobs j using (job_id) group by 1)
select result_id, missing, case when lost then 0 else outside end as outside, case when lost or missing > 0 or outside > 0 then 'FAIL' else 'PASS' end as status from ck""")  # fmt: skip
def q_job_verify(conversations):
    """Results against the jobs they answer: each cited id must exist and be among the job's evidence."""
    a = U.atomize(conversations).select("conv_id", "sequence", F.col("atom_id").alias("id"))
    job = F.concat(F.lit("job"), F.col("conv_id").cast("string"))
    jobs = a.where("sequence < 2").select(job.alias("job_id"), "id", F.lit(True).alias("allowed"))
    every = a.select(job.alias("job_id")).distinct().withColumn("found", F.lit(True))
    cites = a.where("sequence < 1 + conv_id % 3").select("conv_id", "id").union(a.where("conv_id % 5 = 4").select("conv_id", F.lit("none").alias("id"))).distinct()
    own = F.concat(F.lit("job"), F.when(F.col("conv_id") % 9 == 8, -1).otherwise(F.col("conv_id")).cast("string"))
    rows = cites.withColumn("job_id", own).join(every, "job_id", "left").join(jobs, ["job_id", "id"], "left").join(a.select("id").distinct().withColumn("known", F.lit(True)), "id", "left")
    known, lost = F.col("known").isNotNull(), F.col("found").isNull()
    one = rows.groupBy(F.col("conv_id").alias("result_id")).agg(F.bool_or(lost).alias("lost"), F.count_if(~known).alias("missing"), F.count_if(known & F.col("allowed").isNull()).alias("outside"))
    bad = F.col("lost") | (F.col("missing") > 0) | (F.col("outside") > 0)
    return one.select("result_id", "missing", F.when(F.col("lost"), 0).otherwise(F.col("outside")).cast("bigint").alias("outside"), F.when(bad, "FAIL").otherwise("PASS").alias("status"))


@query("events", sql="select event_id, cast(props->>'$.k' as bigint) as k from events where event_type = 'error' and cast(props->>'$.k' as bigint) = 42")
def join_job_lookup(events):
    """Entries of one type whose payload has the asked id, newest first in the reference's log; all of them here."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.where((F.col("event_type") == "error") & (k == 42)).select("event_id", k.alias("k"))


# --- records and change logs


@query("events", sql="with p as (select user_id as origin, event_id as sequence, lag(event_id) over (partition by user_id order by event_id) as before from events) select * from p where before is not null and sequence > before + 1")
def win_mutation_gap(events):
    """Gaps of every user's event ids: the ids are the log's own sequence."""
    return R.gaps(events.select(F.col("user_id").alias("origin"), F.col("event_id").alias("sequence")))


_SEEN = "s as (select user_id as origin, max(event_id) as cursor from events where event_id < 300 group by 1)"


@query("events", sql=f"""with {_SEEN}, l as (select user_id as origin, event_id as sequence, cursor from events left join s on s.origin = user_id where cursor is null or event_id > cursor),
b as (select origin, sequence, case when sequence <> coalesce(lag(sequence) over w, cursor, sequence - 1) + 1 then 1 else 0 end as broken from l window w as (partition by origin order by sequence)) select origin, sequence, sum(broken) over (partition by origin order by sequence) = 0 as accepted from b""")  # fmt: skip
def str_gap(events):
    """What follows each cursor without a gap is taken."""
    log = events.select(F.col("user_id").alias("origin"), F.col("event_id").alias("sequence"))
    return R.in_sequence(log, R.cursors(log.where("sequence < 300"))).select("origin", "sequence", "accepted")


@query("events", sql=f"with {_SEEN} select origin, max(cursor) as cursor from (select * from s union all select user_id, max(event_id) from events group by 1) group by 1")
def agg_max_sequence(events):
    log = events.select(F.col("user_id").alias("origin"), F.col("event_id").alias("sequence"))
    return R.advanced(R.cursors(log.where("sequence < 300")), log)


@query("events", sql="select event_id, user_id from events where event_id not in (select event_id from events where event_type = 'click')")
def join_mutation_dedupe(events):
    rows = events.select("event_id", "user_id")
    return R.new_mutations(rows.union(rows), events.where("event_type = 'click'"), "event_id")


@query("events", sql="select event_id, user_id from events where event_id not in (select event_id from events where event_type = 'error')")
def snk_delete(events):
    return R.without(events.select("event_id", "user_id"), events.where("event_type = 'error'"), "event_id")


_REVISED = "select doc_id, case when doc_id % 5 = 0 then 'revised ' || coalesce(source, '') || ' ' || substr(text, length(text) // 2 + 1) else text end as text from documents where doc_id % 7 <> 0 and text is not null"


@query("documents", sql=f"with d as ({_REVISED}), p as (select doc_id, term, count(*) as n from (select doc_id, unnest({_WORDS}) as term from d) group by all) select term, count(*) as df, count(*) as postings, sum(n)::bigint as n from p group by 1")
def snk_upsert_index(docs):
    """The index of all documents after a batch that revises each fifth and deletes each seventh: frequencies that the batch changed beside what the postings say. The SQL builds the index anew."""
    first = docs.select(F.col("doc_id").alias("record_id"), "source", "text")
    half = F.concat(F.lit("revised "), F.coalesce("source", F.lit("")), F.lit(" "), F.expr("substr(text, length(text) div 2 + 1)"))
    gone = F.col("record_id") % 7 == 0
    touched = first.where((F.col("record_id") % 5 == 0) | gone).select("record_id", F.lit(1).alias("clock"), F.when(~gone, half).alias("text"))
    index = I.updated(I.built(first), touched)
    said = index.postings.groupBy("term").agg(F.count("*").alias("postings"), F.sum("n").alias("n"))
    return index.frequencies.join(said, "term", "full_outer").select("term", "df", "postings", "n")


@query("events", sql="select event_id as sequence, user_id as origin from events where event_id > 100 order by event_id, user_id limit 32")
def topk_pending(events):
    return R.pending(events.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("origin")), 100)


@query("orders", sql="select o_orderkey, o_custkey, row_number() over w as version, lag(o_orderkey) over w as rollback from orders window w as (partition by o_custkey order by o_orderkey)")
def win_latest_version(orders):
    return R.versions(orders.select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], "o_orderkey")


@query("orders", sql="select o_custkey, max(o_orderkey) as prior, count(*) as versions from orders group by 1")
def join_capability_prior(orders):
    """The newest version of each key, and how many there are."""
    v = R.versions(orders.select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], "o_orderkey")
    return v.groupBy("o_custkey").agg(F.max_by("o_orderkey", "version").alias("prior"), F.max("version").cast("bigint").alias("versions"))


@query("orders", sql="select o_orderkey, o_custkey from orders order by o_orderkey desc limit 300")
def topk_reversed_lists(orders):
    return orders.select("o_orderkey", "o_custkey").orderBy(F.desc("o_orderkey")).limit(300)


@query("orders", sql="select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey = 7 order by o_orderkey")
def src_table_scan(orders):
    return orders.where("o_custkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey")


@query("events", sql="select event_id, coalesce(nullif(trim(case when event_id % 3 = 0 then '' else event_type end), ''), nullif(trim(user_id::varchar), ''), '') as clock from events")
def fn_merge_clock(events):
    return events.select("event_id", R.merge_clock(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")), F.col("user_id")).alias("clock"))


_WIRE = {"click": "clicks_wire", "view": "views_wire"}


@query("events", sql="select event_id, case event_type when 'click' then 'clicks_wire' when 'view' then 'views_wire' end as wire from events where event_type in ('click', 'view')")
def prj_wire_alias(events):
    """Local names to wire names by an allow-list; others don't pass."""
    name = F.create_map(*(F.lit(x) for pair in _WIRE.items() for x in pair))[F.col("event_type")]
    return events.where(F.col("event_type").isin(*_WIRE)).select("event_id", name.alias("wire"))


_OD = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


@query("conversations", sql=f"""{_T}, l as (select atom_id, ks, coalesce(lag(ks) over (partition by conv_id order by sequence, idx), []) as before from a), m as (select *, list_concat(before, ks) as both_ from l)
select atom_id, array_to_string({_OD('both_')}, ' ') as united, len(list_intersect(ks, before)) as common, {jaccard('list_distinct(ks)', 'list_distinct(before)')} as jaccard, coalesce(list_filter(ks, lambda x: not list_contains(before, x))[1], ks[1], '') as first_new, array_to_string(list_sort(list_distinct(both_)), ' ') as roots from m""")  # fmt: skip
def set_term_union(conversations):
    """Ordered union, Jaccard, first new word and sorted union of a statement's keywords and those before it."""
    from ..operators.lexical import first_distinct

    w = Window.partitionBy("conv_id").orderBy("sequence", "index")
    a = tables(conversations)[0].select("atom_id", "keywords", F.coalesce(F.lag("keywords").over(w), F.array().cast("array<string>")).alias("before"))
    k, b = F.col("keywords"), F.col("before")
    return a.select("atom_id", F.array_join(F.array_distinct(F.concat(b, k)), " ").alias("united"), F.size(F.array_intersect(k, b)).cast("bigint").alias("common"), T.jaccard(F.array_distinct(k), F.array_distinct(b)).alias("jaccard"),
                    first_distinct(k, b).alias("first_new"), F.array_join(R.merged_roots(b, k), " ").alias("roots"))


for _name, _columns in (("set_distinct_ordered", ("united",)), ("set_first_distinct", ("first_new",)), ("set_merge_roots", ("roots",))):
    QUERIES[_name] = lambda spark, sf, cs=_columns: QUERIES["set_term_union"](spark, sf).select("atom_id", *cs)
    ORACLES[_name] = f"select atom_id, {', '.join(_columns)} from ({ORACLES['set_term_union']})"


@query("conversations", sql=f"{_T} select truth_id, len(list_filter(evidence_ids, lambda x: x in (select atom_id from a where sequence > 0))) = len(evidence_ids) as exist from tr".replace("len(list_filter(evidence_ids, lambda x: x in (select atom_id from a where sequence > 0))) = len(evidence_ids) as exist from tr", "bool_and(k.atom_id is not null) as exist from (select truth_id, unnest(evidence_ids) as id from tr) e left join (select atom_id from a where sequence > 0) k on k.atom_id = e.id group by 1"))
def set_evidence_exists(conversations):
    """Whether all evidence of a truth is among the known statements (here: those after a conversation's first message)."""
    a, t = tables(conversations)
    known = a.where("sequence > 0").select("atom_id", F.lit(True).alias("k"))
    each = t.select("truth_id", F.explode("evidence_ids").alias("atom_id")).join(known, "atom_id", "left")
    return each.groupBy("truth_id").agg(F.bool_and(F.col("k").isNotNull()).alias("exist"))


@query("conversations", sql=f"{_T} select distinct unnest(evidence_ids) as atom_id from tr except select atom_id from a where sequence > 0")
def set_except_missing(conversations):
    a, t = tables(conversations)
    return t.select(F.explode("evidence_ids").alias("atom_id")).subtract(a.where("sequence > 0").select("atom_id"))


@query("conversations", sql=f"with {_MESSAGES} select m.conv_id, sequence, n from messages m join (select conv_id, count(*) as n from messages group by 1) using (conv_id)")
def join_conv_messages(conversations):
    m = C.messages(conversations)
    return m.groupBy("conv_id").agg(F.count("*").alias("n")).join(m.select("conv_id", "sequence"), "conv_id").select("conv_id", "sequence", "n")


@query("conversations", sql=f"{WITH}, {FULL} select m.conv_id, m.sequence, count(atom_id) as n, coalesce(string_agg(atom_id, ' ' order by idx), '') as atoms from messages m left join full_atoms f using (conv_id, sequence) group by 1, 2")
def join_msg_atoms(conversations):
    """Messages with their statements' ids, in order."""
    a = U.atomize(conversations).groupBy("conv_id", "sequence").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "atom_id"))), lambda x: x["atom_id"]), " ").alias("atoms"))
    return C.messages(conversations).select("conv_id", "sequence").join(a, ["conv_id", "sequence"], "left").select("conv_id", "sequence", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("atoms", F.lit("")).alias("atoms"))


@query("events", sql="select event_id, case when v is null then 0.35::double else round(least(greatest(1 - floor(datediff('hour', date_trunc('hour', ts), timestamp '2025-01-01') - case when date_trunc('second', ts) > date_trunc('hour', ts) then 1 else 0 end) / 24::double / 730::double, 0), 1), 9) end as recency from (select *, ts as v from events)")
def fn_recency(events):
    from ..operators.projection import recency

    return events.select("event_id", F.round(recency(F.date_trunc("second", "ts"), F.lit("2025-01-01 00:00:00").cast("timestamp")), 9).alias("recency"))



@query("events", sql="""select event_id, case when event_id % 3 = 0 then make_timestamp((1700000000 + event_id) * 1000000) when event_id % 3 = 1 then ts else null end as at from (select event_id, date_trunc('second', ts) as ts from events)""")
def fn_parse_date(events):
    from ..sources.snapshots import parsed_date

    i = F.col("event_id")
    text = F.when(i % 3 == 0, (i + 1700000000).cast("string")).when(i % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return events.select("event_id", parsed_date(text).alias("at"))


@query("events", sql="select event_id, sha256('{\"a\":' || event_id || ',\"k\":' || cast(props->>'$.k' as bigint) || '}') as hash from events")
def fn_hash_entity(events):
    """Hash of a record's JSON, whatever the order of its fields."""
    from ..sources.snapshots import canonical_json

    record = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return events.select("event_id", F.sha2(canonical_json(record).cast("binary"), 256).alias("hash"))
