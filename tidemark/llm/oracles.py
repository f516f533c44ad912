"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.licenses import PHRASES, TEMPLATES, _mandatory, index
from tidemark.llm.quality import RULES, STOP_WORDS, SYMBOLS
from tidemark.llm.shared import UPPER

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def lower(c: str) -> str:
    return f"translate({c}, '{UPPER}', '{UPPER.lower()}')"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def quality_sql() -> str:
    per = lambda a, b: f"coalesce({a}::double / nullif({b}, 0), 0.0)"
    measures = {
        "n_words": "n_words",
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
        "mean_word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop", "n_words"),
        "duplicate_line_ratio": per("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis", "n_lines"),
        "upper_case_ratio": per("n_upper", "n_chars"),
    }
    broken = []
    for r in RULES:
        tests = [f"{measures[r.measure]} < {r.low}"] * (r.low is not None) + [f"{measures[r.measure]} > {r.high}"] * (r.high is not None)
        broken.append(f"case when {' or '.join(tests)} then '{r.measure}' end")
    return f"""
with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
windows as (select row, i, w[i:i + 2] as k from docs, unnest(range(1, len(w) - 1)) as u(i)),
repeated as (select row, i from windows qualify count(*) over (partition by row, k) > 1),
covered as (select row, count(distinct i + o) as n from repeated, (values (0), (1), (2)) as v(o) group by row),
counts as (
  select docs.row, doc_id, len(w) as n_words, length(regexp_replace(t, '{SPACE}+', '', 'g')) as word_chars, length(t) as n_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) as n_symbols, coalesce(n, 0) as n_repeat_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_upper,
    len(list_filter(w, lambda x: rtrim({lower('x')}, '.,;:!?') in ({quoted(STOP_WORDS)}))) as n_stop
  from docs left join covered on docs.row = covered.row),
measured as (
  select *, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…){SPACE}*$'))) as n_ellipsis from counts),
judged as (select *, list_filter([{', '.join(broken)}], lambda x: x is not null) as broken from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  len(broken) = 0 as kept, array_to_string(broken, ',') as broken_rules
from judged"""


def licenses_sql(votes: int = 2, least: float = 0.5) -> str:
    rare = {w for w, _, _ in index().postings}
    words = ", ".join(
        f"({k}, '{t.label}', {p}, '{w}', {w in rare}, {(p, w) in set(_mandatory(t))}, {len(t.text.split())}, {min(votes, sum(x in rare for x in t.text.split()))}, {len(set(_mandatory(t)))})"
        for k, t in enumerate(TEMPLATES)
        for p, w in enumerate(t.text.split())
    )
    base = " union all ".join(
        f"select row, pos, '{label}' as label from tokens where word = '{p.split()[0]}'"
        + "".join(f" and lead(word, {k}) over (partition by row order by pos) = '{w}'" for k, w in enumerate(p.split()[1:], 1))
        for p, label in PHRASES.items()
    ).replace(" where word", " qualify word")
    return f"""
with docs as (select row_number() over () as row, doc_id, regexp_extract_all({lower("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
tokens as (select row, unnest(w) as word, generate_subscripts(w, 1) - 1 as pos from docs),
places as ({base}),
based as (select row, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as base from places group by row),
template(k, label, p, word, rare, must, size, need, musts) as (values {words}),
aligned as (
  select row, k, any_value(label) as label, pos - p as o, count(*) as same, count(*) filter (rare) as votes, count(*) filter (must) as must, any_value(size) as size, any_value(need) as need, any_value(musts) as musts
  from tokens join template on tokens.word = template.word group by row, k, pos - p),
found as (select row, list(distinct label) as labels, max(same / size) as score from aligned where votes >= need and must = musts and same / size >= {least} group by row)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ','), '') as labels,
  greatest(coalesce(score, 0.0), case when n_base > 0 then 0.5 else 0.0 end)::double as score
from docs left join based on docs.row = based.row left join found on docs.row = found.row"""


def urls_sql(rounds: int = 20, damping: float = 0.85, floor: float = 0.01) -> str:
    """Power iteration over forty hosts, a table a round."""
    host = lambda n: f"'h' || ({n})::varchar || case when {n} < 5 then '.net' when {n} < 10 then '.org' else '.com' end"
    parts = [
        f"""with recursive linked as (select page_id, {host('page_id % 40')} as host, {host('((page_id * page_id + 3) % 40)')} as target,
  regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\\s*=\\s*["'']?(https?://[^\\s"''<>]+)', 1) as own from pages)""",
        "hosts as (select distinct host, host like '%.net' as bad, host like '%.org' as good from linked)",
        """edges as (select src, dst, count(*)::double as weight from (
  select host as src, target as dst from linked union all
  select host, lower(regexp_extract(unnest(own), '^.*?://([^/?#]*)', 1)) from linked) where dst <> '' and src <> dst group by all)""",
    ]
    for name, s, t, seed in (("trust", "src", "dst", "good"), ("distrust", "dst", "src", "bad")):
        parts.append(f"{name}_steps as (select {s} as s, {t} as t, weight / sum(weight) over (partition by {s}) * {damping} as part from edges)")
        parts.append(f"{name}_start as (select host, 1.0::double / count(*) over () as start from hosts where {seed})")
        parts.append(f"{name}_0 as materialized (select host, start as rank from {name}_start)")
        for k in range(1, rounds + 1):
            parts.append(f"{name}_a{k} as materialized (select t as host, sum(rank * part) as rank from {name}_{k - 1} join {name}_steps on host = s group by t)")
            parts.append(
                f"{name}_{k} as materialized (select host, sum(rank) as rank from (select * from {name}_a{k} union all "
                f"select host, start * (1 - coalesce((select sum(rank) from {name}_a{k}), 0)) from {name}_start) group by host)"
            )
    return ",\n".join(parts) + f"""
select page_id, l.host, case when h.bad then 'net/' when h.good then 'org/fr/' end as rule,
  case when h.bad then 'block' when h.good then 'allow' when coalesce(d.rank, 0) > coalesce(t.rank, 0) and coalesce(d.rank, 0) > {floor} / (select count(*) from hosts) then 'block' else 'allow' end as verdict,
  round(coalesce(t.rank, 0), 9) as trust, round(coalesce(d.rank, 0), 9) as distrust
from linked l join hosts h on l.host = h.host left join trust_{rounds} t on l.host = t.host left join distrust_{rounds} d on l.host = d.host"""


def lines_sql() -> str:
    key = f"{lower(f"regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g')")}"
    return f"""
with docs as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
numbered as (select row, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from docs),
keyed as (select row, doc_id, i, line, {key} as key from numbered),
counted as (select key, max(doc_id) as top from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select row, k.doc_id, i, line, top is not null and k.doc_id <> top as gone from keyed k left join counted c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by row, doc_id"""


def fim_sql() -> str:
    """Cut by substring, and restored by the places of the cuts."""
    return """
with hashed as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
drawn as (select doc_id, t, length(t) as n, [('0x' || substr(h, 8 * k + 1, 8))::bigint for k in [0, 1, 2, 3]] as d from hashed),
placed as (select *, least(d[1] % (n + 1), d[2] % (n + 1)) as a, greatest(d[1] % (n + 1), d[2] % (n + 1)) as b,
  if(n = 0 or regexp_matches(t, '<[PSM]>') or d[3] % 100 >= 90, 'plain', if(d[4] % 100 < 20, 'spm', 'psm')) as form from drawn),
parts as (select *, substring(t, 1, a) as p, substring(t, a + 1, b - a) as m, substring(t, b + 1) as s from placed)
select doc_id, n, form, if(form = 'plain', null, a) as prefix_chars, if(form = 'plain', null, b - a) as middle_chars,
  sha256(if(form = 'plain', t, if(form = 'psm', '<P>' || p || '<S>' || s || '<M>' || m, '<S>' || s || '<P>' || p || '<M>' || m))) as output_sha256,
  sha256(t) as restored_sha256
from parts"""


ORACLES: dict[str, str] = {"op11_lines": lines_sql(), "op13_fim": fim_sql(), "urls_linked": urls_sql(), "op6_quality": quality_sql(), "op7_licenses": licenses_sql()}
