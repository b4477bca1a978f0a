"""The engine's own queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations as C
from ..operators import records as R
from ..operators import retrieval as V
from ..operators import search as S

QUERIES, ORACLES = {}, {}
QUERY_TERMS = ["thing", "oning", "ering", "antion", "retion"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
VERSION = "1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(*names: str, sql: str | None = None):
    """Registers a function of DataFrames under its name, over the named tables."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_NORM = rf"trim(regexp_replace(text, '{T.WS}', ' ', 'g'))"
_LOW = f"translate({{}}, '{T.UPPER}', '{T.LOWER}')"
_WORDS = f"list_filter(regexp_split_to_array({_LOW.format(_NORM)}, '[^a-z0-9]+'), lambda x: length(x) >= 3)"
_MESSAGES = f"""messages as (
  select conv_id, row_number() over (partition by conv_id order by turn, text) - 1 as sequence, text,
    case when lower(trim(coalesce(role, ''))) in ('human', 'user', 'prompt') then 'user' when lower(trim(coalesce(role, ''))) in ('assistant', 'model', 'bot', 'ai') then 'assistant'
      when lower(trim(coalesce(role, ''))) = '' then 'unknown' else lower(trim(role)) end as role
  from conversations where {_NORM} <> '')"""


@query("documents", sql=f"select doc_id, {_NORM} as norm from documents")
def fn_normalize_text(docs):
    return docs.select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("documents", sql=f"select doc_id, trim(regexp_replace({_LOW.format('text')}, '[^a-z0-9]+', ' ', 'g')) as norm from documents")
def fn_normalize_search(docs):
    return docs.select("doc_id", T.normalize_search(F.col("text")).alias("norm"))


@query("conversations", sql=f"""
with p as (select conv_id, turn, role, {_NORM} as norm from conversations)
select conv_id, turn, 'msg_' || substr(sha256(concat_ws(chr(9247), '{VERSION}', lower(conv_id::varchar), lower(turn::varchar), lower(trim(coalesce(role, ''))), lower(coalesce(norm, '')))), 1, 24) as id from p""")  # fmt: skip
def fn_canonical_id(conversations):
    return conversations.select("conv_id", "turn", T.canonical_id("msg", VERSION, F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")).alias("id"))


@query("documents", sql=f"select doc_id, array_to_string(list_sort(list_distinct({_WORDS})), ' ') as terms from documents where text is not null")
def fn_terms_ascii(docs):
    return docs.where("text is not null").select("doc_id", F.array_join(F.array_sort(T.terms(F.col("text"))), " ").alias("terms"))


@query("documents", sql="select doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) as n from documents where text is not null")
def fn_word_count(docs):
    return docs.where("text is not null").select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("n"))


@query("pages", sql=f"""select page_id, case when s = '' then 'untitled' else s end as slug from (
  select page_id, substr(regexp_replace(regexp_replace({_LOW.format('url')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 72) as s from pages)""")  # fmt: skip
def fn_slug(pages):
    return pages.select("page_id", T.slug(F.col("url")).alias("slug"))


_SENTENCES = rf"""s as (
  select conv_id, sequence, role, {_NORM} as norm, list_filter(string_split(regexp_replace({_NORM}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 4) as found from messages
), e as (select conv_id, sequence, role, unnest(case when len(found) > 0 then found else [norm] end) as sentence, generate_subscripts(case when len(found) > 0 then found else [norm] end, 1) - 1 as idx from s)"""
_KIND = "case " + " ".join("when regexp_matches(sentence, '" + T.whole_word(w).replace("'", "''") + f"') then '{k}'" for k, w in T.KINDS.items()) + " else 'fact' end"
_ATOMS = rf"""atoms as (
  select conv_id, sequence, role, idx, sentence, kind, polarity, case when kind <> 'hypothesis' and after <> '' then after end as value,
    case when len(words) > 0 then array_to_string(words[1:8], ' ') else sentence end as subject, array_to_string(words[1:12], ' ') as keywords
  from (select *, {_KIND} as kind, case when regexp_matches(sentence, '{T.whole_word(T.NEGATION).replace("'", "''")}') then 'NEGATIVE' else 'NEUTRAL' end as polarity,
      list_filter(regexp_split_to_array({_LOW.format('sentence')}, '[^a-z0-9]+'), lambda x: length(x) >= 3) as words,
      trim(regexp_extract(' ' || sentence, '(?is)^.*[^a-z0-9_]({T.VALUE_VERBS})([^a-z0-9_].*)$', 2)) as after from e))"""


@query("conversations", sql=f"""with {_MESSAGES}, {_SENTENCES}, {_ATOMS}, k as (
  select kind || ':' || array_to_string(list_sort(string_split(subject, ' ')[1:4]), '-') as pattern_key, count(*) as n, count(distinct conv_id) as projects from atoms group by 1 having count(*) >= 3)
select pattern_key, n, projects, round(least(greatest(0.28::double + log2(n + 1) / 9::double + least(0.24::double, 0.06::double * projects), 0), 1), 6) as strength,
  case when n >= 12 and projects >= 2 then 'TESTING' else 'CANDIDATE' end as status, case when n >= 7 and projects >= 2 then 'L3_HYPOTHESIS' else 'L2_CANDIDATE' end as maturity from k""")  # fmt: skip
def q_patterns(conversations):
    return C.patterns(C.statements(C.messages(conversations)))


@query("conversations", sql=f"with {_MESSAGES} select * from messages")
def win_sequence(conversations):
    return C.messages(conversations)


@query("conversations", sql=f"select * from conversations where {_NORM} <> '' and lower(role) not in ('system', 'tool')")
def flt_role_include(conversations):
    return C.spoken(conversations)


@query("conversations", sql=f"with {_MESSAGES} select conv_id, count(*) as message_count, cast(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) as bigint) as word_count from messages group by 1")
def agg_conversation(conversations):
    return C.summaries(C.messages(conversations))


@query("conversations", sql=f"with {_MESSAGES} select conv_id, sequence, cast(greatest(1, count(*) filter (role = 'user') over (partition by conv_id order by sequence)) as bigint) as exchange from messages")
def win_exchange(conversations):
    return C.exchanges(C.messages(conversations))


@query("conversations", sql=f"with {_MESSAGES} select conv_id, sequence // 3 as part, count(*) as n_messages from messages group by 1, 2")
def win_topic_parts(conversations):
    return C.topic_parts(C.messages(conversations), 3)


@query("documents", sql=f"select term, count(*) as df from (select unnest(list_distinct({_WORDS})) as term from documents where text is not null) group by 1")
def agg_df(docs):
    return S.term_frequencies(docs)


@query("documents", sql=f"""with p as (select doc_id, unnest(list_distinct({_WORDS})) as term from documents where text is not null), q as (select * from p where term in ({', '.join(f"'{t}'" for t in QUERY_TERMS)})), f as (select term, count(*) as df from q group by 1)
select doc_id, count(*) as matched, round(sum(1 / df::double), 9) as weight from q join f using (term) group by 1""")  # fmt: skip
def join_terms_postings(docs):
    return S.postings_search(docs, QUERY_TERMS)


@query("documents", sql=f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from documents where text is not null),
b as (select *, {_NORM.replace('text', 's', 1)} = '' as blank from l), i as (select *, count(*) filter (blank) over (partition by doc_id order by line) as island from b)
select doc_id, row_number() over (partition by doc_id order by min(line)) - 1 as paragraph, min(line) as first_line, max(line) as last_line, cast(sum(length(s)) as bigint) as n_chars from i where not blank group by doc_id, island""")  # fmt: skip
def win_paragraph_islands(docs):
    return S.paragraphs(docs)


@query("documents", sql="select doc_id, s as start_offset, least(n, s + 4096) as end_offset from (select doc_id, strlen(text) as n, unnest(range(0, strlen(text), 4096)) as s from documents where text <> '')")
def win_char_shards(docs):
    return S.shards(docs)


@query("documents", sql=f"select sha256(trim(regexp_replace({_LOW.format('text')}, '[^a-z0-9]+', ' ', 'g'))) as checksum, count(*) as n, min(doc_id) as first_doc from documents where text is not null group by 1 having count(*) >= 2")
def agg_duplicate_group(docs):
    return S.checksum_groups(docs)


@query("documents", "benchmark", sql=f"""with d as (select doc_id, list_distinct({_WORDS}) as ts from documents), i as (select item_id, list_distinct({_WORDS}) as ts from benchmark),
j as (select item_id, doc_id, round(len(list_intersect(i.ts, d.ts)) / (len(i.ts) + len(d.ts) - len(list_intersect(i.ts, d.ts)))::double, 9) as similarity from i, d where len(list_intersect(i.ts, d.ts)) > 0)
select item_id, doc_id, similarity from j where similarity >= 0.16 qualify row_number() over (partition by item_id order by similarity desc, doc_id) = 1""")  # fmt: skip
def join_capability_match(docs, items):
    return V.best_matches(docs, items)


def agg_counts(spark, sf_dir):
    return R.counts({t: table(spark, sf_dir, t) for t in TABLES})


QUERIES["agg_counts"] = agg_counts
ORACLES["agg_counts"] = " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in TABLES)


@query("orders", sql="select o_orderkey, o_custkey from orders order by o_orderkey limit 256 offset 512")
def src_paged_scan(orders):
    return R.page(orders.select("o_orderkey", "o_custkey"), "o_orderkey", 512, 256)


@query("events", sql="select event_id, user_id, event_type from events where event_type = 'click' and cast(props->>'$.k' as bigint) = 7")
def flt_json_eq(events):
    return events.where((F.col("event_type") == "click") & (F.get_json_object("props", "$.k").cast("bigint") == 7)).select("event_id", "user_id", "event_type")


@query("events", sql="select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def snk_upsert(events):
    return R.latest(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


@query("events", sql="select event_id, user_id, ts from events order by ts desc, event_id limit 250")
def topk_timeline(events):
    return events.select("event_id", "user_id", "ts").orderBy(F.desc("ts"), "event_id").limit(250)


_LOG = "log as (select user_id as origin, row_number() over (partition by user_id order by ts, event_id) as sequence, event_id, sha256(props) as payload_hash from events)"


@query("events", sql=f"with {_LOG} select origin, (sequence - 1) // 32 as batch, count(*) as n, sha256(string_agg(sequence || ':' || event_id || ':' || payload_hash, '|' order by sequence)) as manifest from log group by 1, 2")
def str_batch_manifest(events):
    return R.manifests(R.mutation_log(events))


@query("events", sql=f"with {_LOG} select origin, max(sequence) as cursor from log group by 1")
def str_cursor(events):
    return R.cursors(R.mutation_log(events))


@query("events", sql="select user_id, ts, props from events qualify row_number() over (partition by user_id order by ts desc, sha256(props) desc) = 1")
def join_merge_records(events):
    rows = events.select("user_id", "ts", "props", "event_id")
    return R.merge(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "ts", "props").select("user_id", "ts", "props")


@query("documents", "labels", sql="select doc_id, source from documents where doc_id in (select doc_id from labels where quality = 1)")
def join_evidence_semi(docs, labels):
    return docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")


@query("labels", "documents", sql="select source, count(*) as n, count(*) filter (quality = 1) as passed, count(*) filter (quality = 0) as failed from labels join documents using (doc_id) group by 1")
def agg_pattern_eval(labels, docs):
    return labels.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("passed"), F.count_if(F.col("quality") == 0).alias("failed"))


def tree(hashes: str) -> str:
    """The levels of a tree of hashes, n4 (leaves) to n0 (root)."""
    levels = [f"n{R.LEAF_DIGITS} as (select substr(h, 1, {R.LEAF_DIGITS}) as prefix, count(*) as n, sha256(string_agg(h, '|' order by h)) as hash from {hashes} group by 1)"]
    for d in reversed(range(R.LEAF_DIGITS)):
        levels.append(f"n{d} as (select substr(c.prefix, 1, {d}) as prefix, sum(c.n)::bigint as n, sha256(string_agg(c.hash, '|' order by c.prefix)) as hash from n{d + 1} c group by 1)")
    return ", ".join(levels)


@query("conversations", sql=f"""with {_MESSAGES}, {_SENTENCES}, {_ATOMS}, {tree("(select distinct sha256(kind || ':' || subject || ':' || coalesce(value, '')) as h from atoms where role = 'user')")} select max(hash) as root from n0""")
def agg_statement_root(conversations):
    """Set hash of all that users state, CURRENT or not, whatever its order."""
    own = C.statements(C.messages(conversations)).where("role = 'user'")
    return R.set_root(own.select(F.sha2(F.concat_ws(":", "kind", "subject", F.coalesce("value", F.lit(""))).cast("binary"), 256).alias("h")))
