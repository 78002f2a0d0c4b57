"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .common import LOWER, UPPER
from .quality_rules import RULES
from .token_rollup import TOKENIZERS

WORD = r"[^\x20\x09-\x0D]+"
WS = r"[\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _values(rows: list[tuple]) -> str:
    cell = lambda v: repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


OP1 = f"""
with v as (select doc_id, source, lang, tok, coalesce(text, '') t, translate(coalesce(text, ''), '|', ' ') u, pat
  from documents, {_values(list(TOKENIZERS.items()))} k(tok, pat)),
c as (select source, lang, tok, len(regexp_extract_all(t, '{WORD}')) w,
  case tok when 'words-1' then len(regexp_extract_all(u, '{TOKENIZERS["words-1"]}')) else len(regexp_extract_all(u, '{TOKENIZERS["pieces-1"]}')) end n from v)
select source, lang, tok tokenizer, cast(count(*) filter (where w >= 10) as bigint) n_docs, cast(coalesce(sum(n) filter (where w >= 10), 0) as bigint) n_tokens
from c group by source, lang, tok"""

METRICS = {"symbols": "n_symbols", "repeats": "n_repeat_words", "dup_lines": "n_dup_lines", "long_words": "word_chars"}
OP2 = f"""
with d as (select doc_id, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
win as (select doc_id, i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) g from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)),
rep as (select doc_id, i, count(*) over (partition by doc_id, g) n from win),
cov as (select doc_id, count(distinct i + k) c from rep, range(0, 5) r(k) where n > 1 group by doc_id),
f as (select d.doc_id, lang, cast(len(w) as bigint) n_words, cast(length(regexp_replace(t, '{WS}', '', 'g')) as bigint) word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) n_symbols,
  cast(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) as bigint) n_dup_lines,
  coalesce(c, 0) n_repeat_words from d left join cov on cov.doc_id = d.doc_id),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from f),
good as (select doc_id, min(quality) = 1 good from labels where doc_id is not null and quality is not null group by doc_id),
held as (select b.*, good from b join good on good.doc_id = b.doc_id where not base_failed),
rules as (select * from {_values([(r, i, float(c)) for r, _, grid in RULES for i, c in enumerate(grid)])} t(rule, i, cut)),
m as (select lang, good, rule, i, cut, case rule {" ".join(f"when '{r}' then {m}" for r, m in METRICS.items())} end / cast(n_words as double) > cut exceeds from held, rules),
n as (select lang, count(*) filter (where good) n, count(*) over () strata from held group by lang),
t as (select m.lang, rule, i, cut, any_value(n) n, any_value(strata) strata, count(*) filter (where good and exceeds) g, count(*) filter (where not good and exceeds) bad from m join n on m.lang is not distinct from n.lang group by m.lang, rule, i, cut),
p as (select *, case when g > n * 0.0125 then 1 else list_sum(list_transform(range(0, g + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(0.0125) + (n - x) * ln(0.9875)))) end p from t),
ok as (select *, max(case when p * strata > 0.0125 then 1 else 0 end) over (partition by lang, rule order by i) failed from p),
use as (select lang, rule, arg_max(cut, (bad - 20 * g) * 100 - i) cut from ok where failed = 0 and bad - 20 * g > 0 group by lang, rule),
bad as (select distinct b.doc_id from b join use on b.lang is not distinct from use.lang where n_words > 0 and case rule {" ".join(f"when '{r}' then {m}" for r, m in METRICS.items())} end / cast(n_words as double) > cut)
select b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.doc_id is null kept from b left join bad on bad.doc_id = b.doc_id"""

OP6 = """
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e as (select *, length(t) + (length(t) - length(replace(t, '\\', ''))) + coalesce(list_sum(list_transform(regexp_extract_all(t, '#{3,}'), lambda x: length(x) - 2)), 0) + (length(t) - length(replace(t, '</turn>', ''))) / 7 + 14 + length(role) n from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn, role, t)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (where role = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, role, t) filter (where role = 'assistant'), '')) loss_sha256,
  cast(sum(n) as bigint) formatted_chars,
  regexp_full_match(string_agg(left(role, 1), '' order by turn, role, t), 's?(ua)+') valid
from e group by conv_id"""

OP7 = f"""
with d as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '{WS}', '', 'g') n from documents),
k as (select doc_id, n, first_value(doc_id) over (partition by n order by length(t) desc, doc_id) keep_id, count(*) over (partition by n) group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(n) text_sha256 from k"""

#: The licence sentences of the tables, spelled out here: sentence, identifier, rule, licence, place of the rule.
NOTICES = [
    ("this work is licensed under the gnu general public license version 3", "gpl3-ref", "gpl3-sentence", "GPL-3.0", 1),
    ("licensed under cc by nc 4 0", "cc-by-nc-ref", "cc-by-nc-sentence", "CC-BY-NC-4.0", 2),
    ("licensed under the apache license version 2 0", "apache2-ref", "apache2-sentence", "Apache-2.0", 3),
    ("released under the mit license", "mit-ref", "mit-sentence", "MIT", 4),
    ("all rights reserved", "reserved", "reserved-sentence", "All-Rights-Reserved", 5),
]
OP8 = f"""
with s as (select doc_id, unnest(parts) part, generate_subscripts(parts, 1) pos from (select doc_id, regexp_split_to_array(coalesce(text, ''), '[.!?]+{WS}|\\n') parts from documents)),
k as (select doc_id, pos, v.* from s join {_values(NOTICES)} v(sentence, id, rule, license, place) on trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) = sentence)
select d.doc_id, count(id) n_sentences, coalesce(string_agg(id, ',' order by pos), '') sentence_ids,
  coalesce(array_to_string(list_transform(list_sort(list_distinct(list((place, rule)) filter (where id is not null))), lambda x: x[2]), ','), '') rules, arg_min(license, place) license
from documents d left join k on k.doc_id = d.doc_id group by d.doc_id"""

OP9 = f"""
with l as (select doc_id, unnest(lines) line, generate_subscripts(lines, 1) pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) lines from documents)),
k as (select *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') key from l),
c as (select key, max(doc_id) keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) n_lines, count(*) filter (where keeper <> doc_id) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where keeper is null or keeper = doc_id), '')) kept_sha256
from k left join c on c.key = k.key group by doc_id"""

ORACLES: dict[str, str] = {
    "op1_token_counts": OP1,
    "op2_quality_rules": OP2,
    "op6_chat_formatting": OP6,
    "op7_exact_dedup": OP7,
    "op8_license_scans": OP8,
    "op9_line_dedup": OP9,
}
