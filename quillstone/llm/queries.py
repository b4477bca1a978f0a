"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op12_tokenization_automaton
from .decontaminate import op1_suffix_array_decontamination
from .divergence import OP13_SQL, op13_heavy_light_divergence
from .fill_middle import OP11_SQL, op11_fill_in_middle
from .jaccard_join import op9_ngram_jaccard_join
from .lm_score import OP4_SQL, op4_cross_entropy_difference
from .packing import op8_best_fit_packing
from .quality import op3_subword_quality
from .quality_rules import op7_decision_list_rules
from .secrets import op6_markov_secrets
from .substring_dedup import op2_doubling_substring_dedup
from .toxicity import op10_cnn_toxicity
from .warc import OP5_SQL, op5_monolithic_warc

QUERIES = {
    "op1_suffix_array_decontamination": op1_suffix_array_decontamination,
    "op2_doubling_substring_dedup": op2_doubling_substring_dedup,
    "op3_subword_quality": op3_subword_quality,
    "op4_cross_entropy_difference": op4_cross_entropy_difference,
    "op5_monolithic_warc": op5_monolithic_warc,
    "op6_markov_secrets": op6_markov_secrets,
    "op7_decision_list_rules": op7_decision_list_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_cnn_toxicity": op10_cnn_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_tokenization_automaton": op12_tokenization_automaton,
    "op13_heavy_light_divergence": op13_heavy_light_divergence,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOW)
OP1_SQL = f"""
with d as (select doc_id, {_ALNUM} as w from documents), i as (select item_id, {_ALNUM} as w from benchmark),
iw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[p:p + 9], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) as p from i)),
dw as (select doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') as g from (select *, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from iw) where len(w) >= k)),
m as (select doc_id, p, k, item_id from dw join iw using (k, g)),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from m) group by 1),
n as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id::varchar as item_id from m) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join n using (doc_id)
"""
OP2_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as g from (select *, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)),
f as (select g, min(doc_id) as low from g group by 1 having min(doc_id) < max(doc_id)),
r as (select distinct doc_id, unnest(range(p, p + 50)) as q from g join f using (g) where low < doc_id),
k as (select doc_id, w, unnest(range(1, len(w) + 1)) as q from d),
t as (select doc_id, count(*) as n_kept, string_agg(w[q], ' ' order by q) as kept from k anti join r using (doc_id, q) group by 1)
select doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join t using (doc_id)
"""
OP9_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[p:p + 4], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as p from d)),
n as (select doc_id, count(*) as n from s group by 1),
o as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from o join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.b) as component_id from d left join n using (doc_id) join r on r.a = d.doc_id group by 1, 2
"""

ORACLES: dict[str, str] = {
    "op9_ngram_jaccard_join": OP9_SQL,
    "op1_suffix_array_decontamination": OP1_SQL,
    "op2_doubling_substring_dedup": OP2_SQL,
    "op4_cross_entropy_difference": OP4_SQL,
    "op5_monolithic_warc": OP5_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_heavy_light_divergence": OP13_SQL,
}
