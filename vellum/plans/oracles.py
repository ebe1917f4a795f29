"""DuckDB SQL with the same rows as the audit queries, where its regular expressions can say the same."""

from __future__ import annotations

from vellum.functions import patterns as P
from vellum.functions import text as T
from vellum.plans.manuscripts import MANUSCRIPTS_SQL

WORD, TOKEN, CJK = (p.replace("'", "''") for p in (T.WORD, T.TOKEN, T.CJK))
TERMS = ["dose", "groups", "link"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(to)}, 'g')"


def tokens(t: str) -> str:
    return f"regexp_extract_all({t}, '{TOKEN}')"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, '{WORD}')"


def squeeze(t: str) -> str:
    return f"trim({sub(t, chr(92) + 's+', ' ')})"


def clean(t: str, markdown: bool = False) -> str:
    t = f"replace({sub(f'coalesce({t}, {q(str())})', chr(13) + chr(10) + '?', chr(10))}, chr(160), ' ')"
    if markdown:
        for p, to in (
            (r"(?s)```.*?```", " "), (r"(?s)~~~.*?~~~", " "), (r"`([^`]*)`", r"\1"), (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]+)\]\([^)]*\)", r"\1"), (r"<[^>]+>", " "),
            (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s*>\s?", ""), (r"(?m)^\s*(?:[-+*]|\d+[.)])\s+", ""), (r"(?m)^\s*[-*_]{3,}\s*$", ""),
        ):
            t = sub(t, p, to)
    for p, to in ((r"[\x00-\x08\x0B-\x1F]", " "), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        t = sub(t, p, to)
    return t


def paragraphs(t: str, least: int) -> str:
    return f"list_filter(list_transform(string_split_regex({t}, '\\n\\s*\\n+'), lambda p: {squeeze('p')}), lambda p: len({tokens('p')}) >= {least})"


def sentences(p: str) -> str:
    for i, a in enumerate(T.ABBREVIATIONS):
        p = sub(p, "(?i)" + a.replace(".", r"\."), chr(0xE000 + i))
    p = sub(p, r"([。！？!?])\s*", "\\1\x01")
    p = sub(p, r"""(\.)\s+(["'“‘(\[]?[A-Z0-9\x{3400}-\x{9fff}])""", "\\1\x01\\2")
    back = "s"
    for i, a in enumerate(T.ABBREVIATIONS):
        back = f"replace({back}, {q(chr(0xE000 + i))}, {q(a)})"
    return f"list_filter(list_transform(string_split({p}, chr(1)), lambda s: {squeeze(back)}), lambda s: len({tokens('s')}) >= 2)"


def all_sentences(t: str, least: int) -> str:
    return f"flatten(list_transform({paragraphs(t, least)}, lambda p: {sentences('p')}))"


LANG = (
    "case when zh = 0 and en = 0 then 'mixed' when zh >= greatest(10, floor(en * 1.2)) then 'zh' when en >= greatest(10, 2 * zh) then 'en' else 'mixed' end"
)
DOCS = f"c as (select doc_id, {clean('text')} as t from documents), cu as (select *, len(regexp_extract_all(t, '{CJK}')) as zh, len({words('t')}) as en from c), cl as (select *, {LANG} as lang from cu)"


def _describe(c: str) -> str:
    cv = f"sqrt((len({c}) * {c}_sq - {c}_sum * {c}_sum)::double) / {c}_sum"
    return f"""len({c}) as {c}_n, {c}_sum, {c}_sq as {c}_squares, list_min({c}) as {c}_min, list_max({c}) as {c}_max,
  list_sort({c})[(len({c}) - 1) // 2 + 1] + list_sort({c})[len({c}) // 2 + 1] as {c}_median_x2,
  case when len({c}) < 4 then 'insufficient_data' when {cv} < 0.18 then 'very_low_variation' when {cv} < 0.32 then 'low_variation' when {cv} < 0.50 then 'moderate_variation' else 'high_variation' end as {c}_variation"""


def _count(t: str, s: str) -> str:
    return f"((length({t}) - length(replace({t}, {q(s)}, ''))) // {len(s)})"


def _labelled(table: str, key: str, columns: list[tuple[str, str]], keep: str = "") -> str:
    pairs = ", ".join(f"{{'label': {q(label)}, 'n': {n}}}" for label, n in columns)
    return f"select {key}, x.label as label, x.n::bigint as n from (select {key}, unnest([{pairs}]) as x from {table} {keep}) where x.n > 0"


def _sections(side: str, name: str) -> str:
    """CTEs of the gate's sections of one side: doc_id, pos, n_sections, level, title, body, key."""
    marked = sub(side, r"(?m)^(#{1,6}\s+\S)", "\x01\\1")
    numbered = r"^\s*(\p{Nd}+)(?:[.、)]|\s)"
    hints = " or ".join(f"contains(lower(ti), {q(h)})" for h in P.REFERENCES)
    return f"""{name}0 as (select doc_id, {side} as raw, list_filter(string_split({marked}, chr(1)), lambda c: regexp_matches(c, '^#{{1,6}}\\s+\\S')) as cs from m),
{name}1 as (select doc_id, unnest(case when len(cs) = 0 then [raw] else cs end) as c, generate_subscripts(case when len(cs) = 0 then [raw] else cs end, 1) - 1 as pos, greatest(len(cs), 1) as n_sections, len(cs) = 0 as bare from {name}0),
{name}2 as (select doc_id, pos, n_sections, bare, case when bare then 1 else length(regexp_extract(c, '^(#{{1,6}})\\s', 1)) end as level,
  case when bare then 'Document' else regexp_extract(c, '^#{{1,6}}\\s+([^\\n]*?)\\s*(?:\\n|$)', 1) end as title,
  case when bare then c else regexp_replace(regexp_replace(c, '^#{{1,6}}\\s+[^\\n]*', ''), '^\\s+|\\s+$', '', 'g') end as body from {name}1),
{name} as (select doc_id, pos, n_sections, level, title, body, case when bare then 'document' when regexp_extract(ti, '{numbered}', 1) <> '' then 'n:' || regexp_extract(ti, '{numbered}', 1)::bigint
  when lower(ti) in ({', '.join(map(q, P.ABSTRACT))}) then 'abstract' when {hints} then 'references' else 't:' || regexp_replace(lower(ti), '[^0-9a-z\\x{{3400}}-\\x{{9fff}}]+', '', 'g') end as key
  from (select *, {squeeze('title')} as ti from {name}2))"""


def _facts() -> str:
    return f"""f0 as (select doc_id, {clean('before', True)} as b, {clean('after', True)} as a from m),
f1 as (select *, len(regexp_extract_all(b || chr(10) || a, '{CJK}')) as zh, len({words('b || chr(10) || a')}) as en from f0),
f2 as (select *, {LANG} as language, len({words('b')}) as wb, len({words('a')}) as wa, len(regexp_extract_all(b, '{CJK}')) as cb, len(regexp_extract_all(a, '{CJK}')) as ca from f1),
facts as (select doc_id, language, case when language <> 'mixed' then language when wa >= ca then 'en' else 'zh' end as move_language,
  case language when 'zh' then cb when 'en' then wb else cb + wb end as before_units, case language when 'zh' then ca when 'en' then wa else ca + wa end as after_units from f2)"""


def units(t: str) -> str:
    zh, en = f"len(regexp_extract_all({t}, '{CJK}'))", f"len({words(t)})"
    return f"case language when 'zh' then {zh} when 'en' then {en} else {zh} + {en} end"


def _versions() -> str:
    pick = lambda s: f"select * from {s} where not (level = 1 and n_sections > 1) qualify row_number() over (partition by doc_id, key order by pos desc) = 1"
    return f"{_sections('before', 'sb')}, {_sections('after', 'sa')}, vb as ({pick('sb')}), va as ({pick('sa')})"


def _difference(lists: dict[str, str]) -> str:
    parts = " union all ".join(f"select doc_id, '{side}' as side, '{k}' as category, unnest({v.replace('TEXT', column)}) as value from m" for k, v in lists.items() for side, column in (("b", "before"), ("a", "after")))
    return f"""it as ({parts}), cnt as (select doc_id, category, value, count(*) filter (side = 'b') as n_before, count(*) filter (side = 'a') as n_after from it group by all),
diff as (select *, greatest(n_before - n_after, 0) as removed, greatest(n_after - n_before, 0) as added from cnt)"""


def _in_words(items: tuple[str, ...]) -> str:
    single = [x for x in items if " " not in x]
    return f"list_filter(regexp_extract_all(lower(TEXT), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w in ({', '.join(map(q, single))}))"


def _phrases(items: tuple[str, ...]) -> str:
    many = sorted((x for x in items if " " in x), key=len, reverse=True)
    return f"regexp_extract_all(lower(TEXT), '\\b(?:{'|'.join(many)})\\b')" if many else "[]::varchar[]"


def _zh(items: tuple[str, ...]) -> str:
    return f"regexp_extract_all(TEXT, '{'|'.join(sorted(items, key=len, reverse=True))}')"


NUMBERS = f"regexp_extract_all(TEXT, '(?:^|[^\\p{{L}}\\p{{N}}_.])({P.PROBABILITY}|{P.NUMBER}(?:\\s*(?:%|{'|'.join(sorted(P.UNITS, key=len, reverse=True))}))?)(?:$|[^\\p{{L}}\\p{{N}}_])', 1)"
IDENTIFIERS = "list_filter(list_transform(list_concat(regexp_extract_all(TEXT, '10\\.\\d{4,9}/[^\\s<>\"]+'), regexp_extract_all(TEXT, 'https?://[^\\s<>\"]+')), lambda v: regexp_replace(v, '[.,;:!?]+$', '')), lambda v: v <> '')"
STANCE = {
    "stance_negation": f"list_concat(list_concat({_in_words((*P.NEGATION['en'], 'cannot'))}, {_phrases(P.NEGATION['en'])}), {_zh(P.NEGATION['zh'])})",
    "stance_modality": f"list_concat({_in_words(P.MODALITY['en'])}, {_zh(P.MODALITY['zh'])})",
    "stance_causal": f"list_concat(list_concat({_in_words(P.CAUSAL['en'])}, {_phrases(P.CAUSAL['en'])}), {_zh(P.CAUSAL['zh'])})",
}
TERM_LIST = "flatten([" + ", ".join(f"list_transform(range({_count('TEXT', t)}), lambda i: {q(t)})" for t in TERMS) + "])"


def _moves(table: dict) -> dict[str, str]:
    bounded = lambda p: p.replace(r"应\b", "应")
    return {k: f"case when move_language = 'zh' then regexp_matches(s, {q('(?i)' + bounded(table['zh'][k]))}) else regexp_matches(s, {q('(?i)' + table['en'][k])}) end" for k in ("claim", "boundary", "recommendation")}


def _profiles() -> str:
    mv = _moves(P.MOVES)
    return f"""{_facts()}, {_sections('after', 'sa')},
bs as (select sa.*, move_language, language from sa join facts using (doc_id) where key not in ('abstract', 'references') and not (level = 1 and n_sections > 1)),
ss as (select doc_id, pos, move_language, unnest(l) as s, generate_subscripts(l, 1) as at_ from (select doc_id, pos, move_language, {all_sentences(clean('body', True), 1)} as l from bs)),
lb as (select doc_id, pos, at_, {', '.join(f'{e} as {k}' for k, e in mv.items())} from ss),
ag as (select doc_id, pos, count(*) as sentences, count(*) filter (claim or boundary or recommendation) as labelled, count(*) filter (claim) as claim, count(*) filter (boundary) as boundary, count(*) filter (recommendation) as recommendation,
  count(*) filter (boundary or recommendation) as either, min(at_) filter (claim) as fc, min(at_) filter (boundary) as fb, min(at_) filter (recommendation) as fr from lb group by 1, 2),
pr as (select bs.doc_id, bs.pos, title as section, coalesce(sentences, 0) as sentences, coalesce(labelled, 0) as labelled, coalesce(claim, 0) as claim, coalesce(boundary, 0) as boundary, coalesce(recommendation, 0) as recommendation, coalesce(either, 0) as either,
  coalesce(nullif(array_to_string(list_transform(list_sort(list_filter([{{'a': fc, 'r': 0, 'l': 'C'}}, {{'a': fb, 'r': 1, 'l': 'B'}}, {{'a': fr, 'r': 2, 'l': 'R'}}], lambda x: x.a is not null)), lambda x: x.l), '-'), ''), 'none') as profile
  from bs left join ag using (doc_id, pos))"""


def _grams(t: str) -> str:
    low = f"lower({squeeze(t)})"
    stop = ", ".join(map(q, sorted(P.VECTOR_STOPWORDS)))
    return f"list_filter({words(low)}, lambda w: length(w) > 2 and w not in ({stop}))"


def _gram_counts(table: str, by: str, pair: tuple[str, str]) -> str:
    """Content grams of both sides; texts whose language is zh don't occur in the view."""
    out = []
    for side, column in zip("ba", pair):
        out.append(f"select {by}, '{side}' as side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as gram from (select {by}, {_grams(column)} as w from {table})")
    return f"gr as ({' union all '.join(out)}), gc as (select {by}, gram, count(*) filter (side = 'b') as nb, count(*) filter (side = 'a') as na from gr group by all)"


def _texture() -> str:
    numbered = r"^\s*\d+(?:[.、)]|\s)"
    hints = " or ".join(f"contains(lower(title), {q(h)})" for h in P.REFERENCES)
    mv = _moves(P.TEXTURE_MOVES)
    hit = lambda c, t: f"(case when move_language = 'zh' then regexp_matches({c}, {q('(?i)' + t['zh'])}) else regexp_matches({c}, {q('(?i)' + t['en'])}) end)"
    meta = lambda c: "(case when move_language = 'zh' then " + " + ".join(f"len(regexp_extract_all({c}, {q('(?i)' + p)}))" for _, p in P.META["zh"]) + " else " + " + ".join(f"len(regexp_extract_all({c}, {q('(?i)' + p)}))" for _, p in P.META["en"]) + " end)"
    return f"""{_sections('after', 'sa')}, l0 as (select doc_id, {clean('after', True)} as t from m), l1 as (select doc_id, len(regexp_extract_all(t, '{CJK}')) as zh, len({words('t')}) as en from l0),
lg as (select doc_id, {LANG} as language, case when {LANG} = 'zh' then 'zh' else 'en' end as move_language from l1),
nm as (select *, bool_or(regexp_matches(trim(title), '{numbered}')) over (partition by doc_id) as has from sa),
tb as (select doc_id, row_number() over (partition by doc_id order by pos) - 1 as pos, title, body from nm where case when has then regexp_matches(trim(title), '{numbered}') else lower(title) not in ({', '.join(map(q, P.ABSTRACT))}) and not ({hints}) and not (level = 1 and n_sections > 1) end),
tp as (select tb.*, language, move_language, {paragraphs(clean('body', True), 1)} as p from tb join lg using (doc_id)),
ts as (select *, list_transform(p, lambda p: {sentences('p')}) as sp from tp),
tf as (select *, flatten(sp) as s, coalesce(p[-1], '') as last, coalesce(sp[-1], []) as final from ts),
tx as (select doc_id, pos, title, body, language, move_language, len(p)::bigint as paragraphs, list_transform(p, lambda p: {units('p')}) as pu, list_transform(sp, lambda x: len(x)) as sc, len(s)::bigint as sentences,
  {', '.join(f"len(list_filter(s, lambda s: {e}))::bigint as {k}" for k, e in mv.items())}, len(list_filter(s, lambda s: {hit('s', P.CORRECTIVE)}))::bigint as corrective, {meta('body')} as meta,
  last <> '' and {hit('last', P.CORRECTIVE)} as closure_corrective, last <> '' and ({hit('last', P.CLOSURE)} or {meta('last')} > 0) as closure_judgement,
  len(list_filter(final, lambda s: ({mv['boundary']}) or ({mv['recommendation']}))) > 0 as closure_boundary from tf)"""


def _geometry(c: str) -> str:
    mode = f"list_sort(list_transform(list_distinct({c}), lambda v: {{'m': -len(list_filter({c}, lambda x: x = v)), 'f': list_position({c}, v), 'v': v}}))[1]"
    return f"len({c})::bigint as {c}_n, coalesce(list_sum({c}), 0)::bigint as {c}_sum, coalesce(list_sum(list_transform({c}, lambda x: x * x)), 0)::bigint as {c}_squares, list_min({c}) as {c}_min, list_max({c}) as {c}_max, {mode}.v as {c}_mode, -{mode}.m as {c}_mode_count"


def _rollup() -> str:
    return f"""{_texture()}, ru as (select doc_id, any_value(language) as language, count(*) as sections, sum(sentences)::bigint as sentences, sum(boundary)::bigint as boundary, sum(recommendation)::bigint as recommendation, sum(corrective)::bigint as corrective,
  count(*) filter (claim > 0 and boundary > 0 and recommendation > 0) as all_three, count(*) filter (meta > 0) as meta_sections, count(*) filter (closure_corrective) as closure_corrective, count(*) filter (closure_judgement) as closure_judgement, count(*) filter (closure_boundary) as closure_boundary,
  sum(meta)::bigint as meta, list(paragraphs order by pos) as paragraphs_per_section, flatten(list(pu order by pos)) as paragraph_units, flatten(list(sc order by pos)) as sentences_per_paragraph from tx group by doc_id),
rg as (select * exclude (paragraphs_per_section, paragraph_units, sentences_per_paragraph), {', '.join(map(_geometry, ('paragraphs_per_section', 'paragraph_units', 'sentences_per_paragraph')))} from ru)"""


def _cv(n: str, s: str, sq: str) -> str:
    return f"(case when {s} > 0 then case when {n} > 1 then sqrt(({n} * {sq} - {s} * {s})::double / ({n} * ({n} - 1))) / ({s} / {n}) else 0.0 end end)"


def _item(v: str) -> str:
    return sub(squeeze(v), "[.,;:，。；：]+$", "")


GUARD_NUMBERS = "list_transform(regexp_extract_all(TEXT, " + q(r"(?:^|[^\p{L}\p{N}_.])(" + P.GUARD_NUMBER.removeprefix(r"(?U)(?<![\w.])") + ")") + f", 1), lambda v: {_item('v')})"
GUARD_CITATIONS = "list_transform(flatten([" + ", ".join(f"regexp_extract_all(TEXT, {q(p.replace('(?iU)', '(?i)'))})" for p in P.GUARD_CITATIONS) + f"]), lambda v: {_item('v')})"
_NAMES = r"[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’\-]+\s*\((?:19|20)\d{2}[a-z]?\)"
CITATIONS = f"list_concat(regexp_extract_all(TEXT, {q(_NAMES)}), regexp_extract_all(TEXT, {q(chr(92) + '[' + chr(92) + 's*' + chr(92) + 'd+(?:' + chr(92) + 's*[,;]' + chr(92) + 's*' + chr(92) + 'd+)*' + chr(92) + 's*' + chr(92) + ']')}))"


def _lengths(side: str) -> str:
    solid = lambda x: f"length({sub(x, chr(92) + 's+', '')})"
    marked = sub(sub(side, r"([.!?。！？])\s+", "\\1\x01"), "[；;]+", "\x01")
    lists = {f"{side}_sentence": f"string_split({marked}, chr(1))", f"{side}_paragraph": f"string_split_regex({side}, '\\n\\s*\\n+')"}
    return ", ".join(f"list_filter(list_transform({v}, lambda x: {solid('x')}), lambda n: n > 0) as {k}" for k, v in lists.items())


def _guard(pairs) -> dict[str, str]:
    names = [f"{s}_{k}" for s in ("before", "after") for k in ("sentence", "paragraph")]
    lengths = ", ".join(f"len({n}) as {n}_n, coalesce(list_sum({n}), 0)::bigint as {n}_sum, coalesce(list_sum(list_transform({n}, lambda x: x * x)), 0)::bigint as {n}_squares, coalesce(list_min({n}), 0) as {n}_min, coalesce(list_max({n}), 0) as {n}_max" for n in names)
    grams = lambda c: f"list_distinct(list_transform(range(1, len({c}) - 3), lambda i: array_to_string({c}[i:i+4], ' ')))"
    gw = lambda c: f"regexp_extract_all(replace(lower({c}), 'ß', 'ss'), {q(T.WORD.replace('A-Z', '').replace('’', '') + '|' + chr(92) + 'p{Nd}+(?:' + chr(92) + '.' + chr(92) + 'p{Nd}+)?')})"
    terms = ", ".join(f"{{'term': {q(t)}, 'b': {_count('before', t)}, 'a': {_count('after', t)}}}" for t in TERMS)
    differ = " or ".join(f"{_count('before', t)} <> {_count('after', t)}" for t in TERMS)
    heads = lambda c: f"regexp_extract_all({c}, {q('(?m)^' + chr(92) + 's{0,3}#{1,6}' + chr(92) + 's+(.+?)' + chr(92) + 's*$')}, 1)"
    solid = lambda c: f"length({sub(c, chr(92) + 's+', '')})"
    return {
        "guard_numbers": pairs(_difference({"numbers": GUARD_NUMBERS}), "select doc_id, value, n_before, n_after, removed, added from diff where n_before <> n_after"),
        "guard_citations": pairs(_difference({"citations": GUARD_CITATIONS}), "select doc_id, value, n_before, n_after, removed, added from diff where n_before <> n_after"),
        "lock_citations": pairs(_difference({"citations": CITATIONS}), "select doc_id, value, n_before, n_after, removed, added from diff"),
        "guard_lengths": pairs(f"l as (select doc_id, {_lengths('before')}, {_lengths('after')} from m)", f"select doc_id, {lengths} from l"),
        "guard_overlap": pairs(
            f"w as (select doc_id, {gw('before')} as b, {gw('after')} as a from m), g as (select doc_id, {grams('b')} as x, {grams('a')} as y from w), n as (select doc_id, len(x) as original_ngrams, len(y) as revised_ngrams, len(list_intersect(x, y)) as shared_ngrams from g)",
            "select doc_id, '5-word' as mode, original_ngrams, revised_ngrams, shared_ngrams, case when original_ngrams + revised_ngrams > 0 then shared_ngrams / (original_ngrams + revised_ngrams - shared_ngrams) else 1.0 end as jaccard, case when original_ngrams > 0 then shared_ngrams / original_ngrams else 1.0 end as original_recall from n",
        ),
        "guard_terms": pairs("z as (select 1)", f"select doc_id, x.term as term, x.b::bigint as n_before, x.a::bigint as n_after from (select doc_id, unnest([{terms}]) as x from m) where x.b <> x.a"),
        "guard_blockers": pairs(
            f"{_difference({'numbers': GUARD_NUMBERS, 'citations': GUARD_CITATIONS})}, sm as (select doc_id, " + ", ".join(f"sum({c}) filter (category = '{k}') as {k}_{c}" for k in ("numbers", "citations") for c in ("removed", "added")) + f" from diff group by 1), r as (select m.doc_id, {solid('before')} as original_units, {solid('after')} as revised_units, {differ} as t, {heads('before')} as hb, {heads('after')} as ha, sm.* exclude (doc_id) from m left join sm using (doc_id)), "
            "l as (select *, array_to_string(list_filter([case when numbers_removed > 0 then 'numbers removed or changed' end, case when numbers_added > 0 then 'numbers added or changed' end, case when citations_removed > 0 then 'citations removed or changed' end, case when citations_added > 0 then 'citations added or changed' end, case when t then 'protected-term counts changed' end, case when len(hb) > 0 and hb <> ha then 'Markdown heading text/order changed' end, case when original_units > 0 and revised_units / original_units < 0.55 then 'length retention below 0.55' end, case when original_units > 0 and revised_units / original_units > 1.80 then 'length expansion above 1.80' end], lambda x: x is not null), '; ') as b from r)",
            "select doc_id, original_units, revised_units, b as blockers, case when b = '' then 'PASS' else 'FAIL' end as status from l",
        ),
        "triadic_lists": f"with {MANUSCRIPTS_SQL}, {DOCS.replace('text', 'before').replace('from documents', 'from m')}, s as (select doc_id, lang, unnest(l) as s, generate_subscripts(l, 1) - 1 as pos from (select doc_id, lang, {all_sentences('t', 4)} as l from cl)) select doc_id, pos, substr(s, 1, 220) as sentence from s where (lang <> 'en' and regexp_matches(s, {q(P.TRIAD_ZH)})) or (lang <> 'zh' and regexp_matches(s, {q('(?i)' + P.TRIAD_EN)}))",
    }


def _codes(rules: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"case when {c} then {q(code)} end" for c, code in rules) + "], lambda x: x is not null), ',')"


STATUS = "case when failures <> '' then 'fail' when warnings <> '' then 'review' else 'pass' end as status"


def _rules(pairs) -> dict[str, str]:
    per, size, sent = "paragraphs_per_section", "paragraph_units", "sentences_per_paragraph"
    cv = lambda g: f"round({_cv(g + '_n', g + '_sum', g + '_squares')}, 3)"
    cover = lambda g: f"round({g}_mode_count / {g}_n, 4)"
    share = lambda a, b: f"(case when {b} > 0 then {a} / {b} else 0.0 end)"
    t1 = f"sections >= 8 and {cv(per)} < 0.10 and ({cover(per)} >= 0.60 or {per}_max - {per}_min <= 1)"
    t6 = f"sections >= 8 and {share('closure_judgement', 'sections')} >= 0.75"
    warn = [
        (t1, "T01_SECTION_PARAGRAPH_COUNT_HOMOGENEITY"), (f"{size}_n >= 40 and {cv(size)} < 0.18", "T02_PARAGRAPH_LENGTH_HOMOGENEITY"), (f"{sent}_n >= 40 and {cv(sent)} < 0.20 and {cover(sent)} >= 0.45", "T03_SENTENCE_COUNT_PER_PARAGRAPH_HOMOGENEITY"),
        (f"sentences >= 80 and {share('corrective', 'sentences')} >= 0.22", "T04_CORRECTIVE_NEGATION_SATURATION"), (f"meta >= 4 or {share('meta_sections', 'sections')} >= 0.25", "T05_META_ADJUDICATION_VOICE"), (t6, "T06_UNIFORM_ADJUDICATIVE_SECTION_ENDINGS"),
        (f"sections >= 8 and {share('all_three', 'sections')} >= 0.75", "T07_ALL_SECTIONS_USE_CLAIM_BOUNDARY_RECOMMENDATION_SET"), (f"sections >= 8 and {share('closure_boundary', 'sections')} >= 0.80", "T08_BOUNDARY_OR_RECOMMENDATION_CLOSURE_SATURATION"),
    ]
    strong = " + ".join(f"coalesce(({c})::int, 0)" for c, code in warn if code[:3] not in ("T02", "T03"))
    strict = _codes([(f"{strong} >= 3", "G01_COMBINED_TEMPLATE_SATURATION"), (f"({t1}) and ({t6}) and {share('all_three', 'sections')} >= 0.90", "G02_SECTION_GEOMETRY_AND_MOVE_SET_LOCKSTEP")])
    low = f"lr as (select doc_id, count(*) as low from (select vb.doc_id, vb.key, {units('vb.body')} as bu, {units('va.body')} as au from vb join va using (doc_id, key) join facts using (doc_id)) where key not in ('abstract', 'references') and bu > 0 and round(au / bu, 4) < 0.5 group by 1)"
    changes = "hc as (select doc_id, count(*) filter (c = 'm') as missing, count(*) filter (c = 'a') as added from (select doc_id, 'm' as c from vb anti join va using (doc_id, key) union all select doc_id, 'a' from va anti join vb using (doc_id, key)) group by 1)"
    residue = " + ".join(f"len(regexp_extract_all(after, {q('(?i)' + p)}))" for _, p in P.RESIDUE)
    places = " + ".join(f"len(regexp_extract_all(after, {q('(?i)' + p)}))" for p in P.PLACEHOLDERS)
    prof = _profiles()
    versions = f"{_sections('before', 'sb')}, " + ", ".join(f"v{x} as (select * from s{x} where not (level = 1 and n_sections > 1) qualify row_number() over (partition by doc_id, key order by pos desc) = 1)" for x in "ba")
    modes = "pm as (select doc_id, profile, count(*) as n, min(pos) as f from pr group by 1, 2), pt as (select doc_id, profile as common_profile, n as common_count from pm qualify row_number() over (partition by doc_id order by n desc, f) = 1), pz as (select doc_id, count(*) as sections, any_value(common_profile) as common_profile, any_value(common_count) as common_count, count(*) filter (claim > 0 and boundary > 0) as claim_boundary, sum(sentences)::bigint as sentences, sum(either)::bigint as either from pr join pt using (doc_id) group by 1)"
    arch = f"u as (select doc_id, {units('body')} as u from bs), ar as (select doc_id, count(*) as body, round({_cv('n', 's', 'k')}, 3) as cv from (select doc_id, count(*) as n, sum(u)::bigint as s, sum(u * u)::bigint as k from u group by 1) group by doc_id, n, s, k), an as (select doc_id, count(*) as body_n from u group by 1)"
    hints = " or ".join(f"contains(lower(title), {q(h)})" for h in P.CONCLUSION)
    cosine = f"ax as (select doc_id, arg_min(body, pos) filter (key = 'abstract') as p, arg_max(body, pos) filter ({hints}) as r from sa group by 1), ay as (select * from ax where p is not null and r is not null), {_gram_counts('ay', 'doc_id', ('p', 'r'))}, ac as (select doc_id, round(sum(nb * na)::bigint / (sqrt(sum(nb * nb)::double) * sqrt(sum(na * na)::double)), 4) as cosine from gc group by 1)"
    fail = _codes([("before_units > 0 and after_units / before_units < 0.65", "G02_OVERALL_RETENTION"), ("low > 0", "G03_SECTION_RETENTION"), ("missing > 0", "G04_MISSING_HEADINGS")])
    ready = _codes([
        ("after_units < 300", "G01_MIN_OUTPUT_UNITS"), ("before_units > 0 and after_units / before_units < 0.65", "G02_OVERALL_RETENTION"), ("low > 0", "G03_SECTION_RETENTION"), ("missing > 0", "G04_MISSING_HEADINGS"),
        (f"{residue} > 0", "G05_EDITORIAL_RESIDUE"), (f"{places} > 0", "G06_SOURCE_PLACEHOLDERS"),
    ])
    shape = [
        ("body_n >= 8 and cv < 0.22", "W03_HOMOGENISED_SECTION_ARCHITECTURE"),
        ("sections >= 8 and ((common_count / sections >= 0.5 and common_profile <> 'none') or (claim_boundary / sections >= 0.75 and cv < 0.25))", "W04_REPEATED_RHETORICAL_PROFILE"), ("sentences >= 40 and either / sentences >= 0.35", "W05_BOUNDARY_RECOMMENDATION_SATURATION"),
        ("cosine >= 0.5", "W06_ABSTRACT_CONCLUSION_OVERLAP"), ("added > 0", "W07_ADDED_HEADINGS"),
    ]
    review, beyond = _codes([(f"{residue} > 0", "W01_EDITORIAL_RESIDUE"), (f"{places} >= 5", "W02_REPEATED_SOURCE_PLACEHOLDER"), *shape]), _codes(shape)
    tables = " ".join(f"left join {t} using (doc_id)" for t in ("facts", "lr", "hc", "pz", "ar", "an", "ac"))
    return {
        "texture_signals": pairs(_rollup(), f"select *, {STATUS} from (select doc_id, {_codes(warn)} as warnings, '' as failures from rg)"),
        "texture_signals_strict": pairs(_rollup(), f"select *, {STATUS} from (select doc_id, {_codes(warn)} as warnings, {strict} as failures from rg)"),
        "meta_voice": pairs(_texture(), _meta_rows()),
        "gate_findings_ready": pairs(f"{prof}, {versions}, {low}, {changes}, {modes}, {arch}, {cosine}", f"select *, {STATUS} from (select m.doc_id, {ready} as failures, {beyond} as warnings from m {tables})"),
        "gate_findings": pairs(f"{prof}, {versions}, {low}, {changes}, {modes}, {arch}, {cosine}", f"select *, {STATUS} from (select m.doc_id, {fail} as failures, {review} as warnings from m {tables})"),
    }


def _meta_rows() -> str:
    rows = lambda lang: ", ".join(f"{{'label': {q(label)}, 'n': len(regexp_extract_all(body, {q('(?i)' + p)}))}}" for label, p in P.META[lang])
    return f"select doc_id, pos, x.label as label, x.n::bigint as n from (select doc_id, pos, unnest(case when move_language = 'zh' then [{rows('zh')}] else [{rows('en')}] end) as x from tx) where x.n > 0"


def oracle_sql() -> dict[str, str]:
    with_docs = lambda body: f"with {DOCS} {body}"
    pairs = lambda ctes, body: f"with {MANUSCRIPTS_SQL}, {ctes} {body}"
    dash = "len(regexp_extract_all(t, '—|–')) + len(list_filter(regexp_extract_all(t, '-+'), lambda x: length(x) = 2))"
    stop = ", ".join(map(q, sorted(P.STOPWORDS)))
    term = lambda t: f"len(regexp_extract_all(t, {q('(?i)' + chr(92) + 'b' + t + chr(92) + 'b')}))" if " " in t else f"len(list_filter(ws, lambda w: w = {q(t)}))"
    kinds = []
    for kind in P.TERMS_EN:
        cols = [f"{{'m': -(case when lang <> 'zh' then {term(t)} else 0 end), 'term': {q(t)}}}" for t in P.TERMS_EN[kind]] + [f"{{'m': -(case when lang <> 'en' then {_count('t', t)} else 0 end), 'term': {q(t)}}}" for t in P.TERMS_ZH[kind]]
        kinds.append(f"select doc_id, {q(kind)} as kind, x.term as term, (-x.m)::bigint as n from (select doc_id, unnest(list_sort(list_filter([{', '.join(cols)}], lambda x: x.m < 0))[1:10]) as x from tw)")
    out = {
        "doc_tokens": f"select doc_id, len(tk) as n_tokens, md5(array_to_string(tk, ' ')) as tokens_md5 from (select doc_id, {tokens('coalesce(text, chr(32))')} as tk from documents)",
        "doc_units_language": with_docs("select doc_id, lang as language, case lang when 'zh' then zh when 'en' then en else zh + en end as units, zh as cjk, en as words from cl"),
        "doc_sentences": with_docs(f"select doc_id, len(p) as n_paragraphs, len(s) as n_sentences, md5(array_to_string(s, chr(10))) as sentences_md5 from (select doc_id, p, flatten(list_transform(p, lambda p: {sentences('p')})) as s from (select doc_id, {paragraphs('t', 4)} as p from c))"),
        "length_variation": with_docs(f""", d as (select doc_id, list_transform(p, lambda x: len({tokens('x')})) as paragraph, list_transform(flatten(list_transform(p, lambda p: {sentences('p')})), lambda x: len({tokens('x')})) as sentence from (select doc_id, {paragraphs('t', 4)} as p from c)),
e as (select *, {', '.join(f"coalesce(list_sum({c}), 0)::bigint as {c}_sum, coalesce(list_sum(list_transform({c}, lambda x: x * x)), 0)::bigint as {c}_sq" for c in ('sentence', 'paragraph'))} from d)
select doc_id, {_describe('sentence')}, {_describe('paragraph')} from e"""),
        "lexical_diversity": with_docs(f"select doc_id, n as n_tokens, u as unique_tokens, case when n > 0 then u / n end as type_token_ratio, case when n > 0 then u / sqrt(n::double) end as root_ttr from (select doc_id, len(k) as n, len(list_distinct(k)) as u from (select doc_id, list_transform({tokens('t')}, lambda x: lower(x)) as k from c))"),
        "punctuation_density": with_docs(f"select doc_id, ({dash})::bigint as dashes, {_count('t', ';')} + {_count('t', '；')} as semicolons, {_count('t', ':')} + {_count('t', '：')} as colons, least({_count('t', '(')}, {_count('t', ')')}) + least({_count('t', '（')}, {_count('t', '）')}) as parenthetical_pairs from c"),
        "punctuation_per_thousand": with_docs(f", pt as (select doc_id, len({tokens('t')}) as n, {dash} as dashes, {_count('t', ';')} + {_count('t', '；')} as semicolons, {_count('t', ':')} + {_count('t', '：')} as colons, least({_count('t', '(')}, {_count('t', ')')}) + least({_count('t', '（')}, {_count('t', '）')}) as parenthetical_pairs from c) select doc_id, n as n_tokens, " + ", ".join(f"case when n > 0 then {k} * 1000.0::double / n else 0.0 end as {k}_per_thousand" for k in ("dashes", "semicolons", "colons", "parenthetical_pairs")) + " from pt"),
        "paragraph_openings": f"""with {MANUSCRIPTS_SQL}, {DOCS.replace('text', 'before').replace('from documents', 'from m')}, s as (select doc_id, lang, unnest(l) as s, generate_subscripts(l, 1) as pos from (select doc_id, lang, {paragraphs('t', 4)} as l from cl)),
o as (select doc_id, pos, s, case when lang = 'zh' then array_to_string(w[1:n], '') else array_to_string(w[1:n], ' ') end as opening from (select *, list_transform({tokens('s')}, lambda x: lower(x)) as w, case when lang = 'zh' then 5 else 4 end as n from s) where len(w) >= greatest(n + 2, 5)),
g as (select doc_id, opening, count(*) as n, min(pos) as pos, arg_min(s, pos) as s from o group by 1, 2)
select doc_id, opening, n, substr(s, 1, 180) as example from (select *, row_number() over (partition by doc_id order by n desc, pos) as rank from g) where rank <= 10 and n >= 2""",
        "sentence_openings": with_docs(f""", s as (select doc_id, lang, unnest(l) as s, generate_subscripts(l, 1) as pos from (select doc_id, lang, {all_sentences('t', 4)} as l from cl)),
o as (select doc_id, pos, s, case when lang = 'zh' then array_to_string(w[1:n], '') else array_to_string(w[1:n], ' ') end as opening from (select *, list_transform({tokens('s')}, lambda x: lower(x)) as w, case when lang = 'zh' then 4 else 3 end as n from s) where len(w) >= greatest(n + 2, 5)),
g as (select doc_id, opening, count(*) as n, min(pos) as pos, arg_min(s, pos) as s from o group by 1, 2)
select doc_id, opening, n, substr(s, 1, 180) as example from (select *, row_number() over (partition by doc_id order by n desc, pos) as rank from g) where rank <= 10 and n >= 2"""),
        "repeated_trigrams": with_docs(f""", w as (select doc_id, list_transform({words('t')}, lambda x: lower(x)) as w from cl where lang <> 'zh'),
g as (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as phrase, unnest(range(1, len(w) - 1)) as pos from w),
h as (select doc_id, phrase, count(*) as n, min(pos) as pos from g where len(list_filter(string_split(phrase, ' '), lambda x: x not in ({stop}))) > 0 group by 1, 2 having count(*) >= 3)
select doc_id, phrase, n from (select *, row_number() over (partition by doc_id order by n desc, pos) as rank from h) where rank <= 10"""),
        "stock_phrases": f"with {MANUSCRIPTS_SQL}, {DOCS.replace('text', 'before').replace('from documents', 'from m')}, x as ({_labelled('cl', 'doc_id', [(a, f'case when lang <> {q(chr(122) + chr(104))} then len(regexp_extract_all(t, {q(chr(40) + chr(63) + chr(105) + chr(115) + chr(41) + p)})) else 0 end') for a, p in P.STOCK_EN] + [(a, f'case when lang <> {q(chr(101) + chr(110))} then len(regexp_extract_all(t, {q(chr(40) + chr(63) + chr(115) + chr(41) + p)})) else 0 end') for a, p in P.STOCK_ZH])}) select doc_id, label, n from x qualify row_number() over (partition by doc_id order by n desc, label) <= 10",
        "transition_hedge_booster": f"with {MANUSCRIPTS_SQL}, {DOCS.replace('text', 'before').replace('from documents', 'from m')}, tw as (select *, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+') as ws from cl) {' union all '.join(kinds)}",
        "clean_markdown_pages": f"select page_id, length(t) as chars, md5(t) as text_md5 from (select page_id, {clean('html', True)} as t from pages)",
        "lock_numbers": pairs(_difference({"numbers": NUMBERS}), "select doc_id, value, n_before, n_after, removed, added from diff"),
        "lock_identifiers": pairs(_difference({"identifiers": IDENTIFIERS}), "select doc_id, value, n_before, n_after, removed, added from diff"),
        "lock_stance": pairs(_difference(STANCE), "select doc_id, category, value, n_before, n_after, removed, added from diff"),
        "lock_terms": pairs(_difference({"terms": TERM_LIST}), "select doc_id, value, n_before, n_after, removed, added from diff"),
        "guard_templates": pairs("l as (select doc_id, replace(lower(before), 'ß', 'ss') as b, replace(lower(after), 'ß', 'ss') as a from m)", f"select doc_id, x.p as phrase, x.b::bigint as n_before, x.a::bigint as n_after from (select doc_id, unnest([{', '.join(f'{{{q(chr(112))}: {q(p)}, {q(chr(98))}: {_count(chr(98), p)}, {q(chr(97))}: {_count(chr(97), p)}}}' for p in P.TEMPLATES)}]) as x from l) where x.b + x.a > 0"),
        "sections": pairs(_sections("after", "sa"), "select doc_id, pos, level, title, key, length(body) as body_chars, md5(body) as body_md5 from sa"),
        "section_retention": pairs(f"{_facts()}, {_versions()}", f"select *, case when before_units > 0 then after_units / before_units end as retention from (select vb.doc_id, vb.key, vb.title as before_title, va.title as after_title, {units('vb.body')} as before_units, {units('va.body')} as after_units from vb join va using (doc_id, key) join facts using (doc_id))"),
        "heading_changes": pairs(_versions(), "select doc_id, 'missing' as change, title from vb anti join va using (doc_id, key) union all select doc_id, 'added', title from va anti join vb using (doc_id, key)"),
        "content_recall": pairs(f"{_versions()}, x as (select vb.doc_id, vb.key, vb.body as p, va.body as r from vb join va using (doc_id, key)), {_gram_counts('x', 'doc_id, key', ('p', 'r'))}, sm as (select doc_id, key, sum(least(nb, na)) as retained, sum(nb) as total from gc group by 1, 2)", "select x.doc_id, x.key, coalesce(retained, 0)::bigint as retained, coalesce(total, 0)::bigint as total, case when total > 0 then retained::bigint / total::bigint else 1.0 end as recall from x left join sm using (doc_id, key)"),
        "abstract_conclusion_cosine": pairs(f"{_sections('after', 'sa')}, x as (select doc_id, arg_min(body, pos) filter (key = 'abstract') as p, arg_max(body, pos) filter ({' or '.join(f'contains(lower(title), {q(h)})' for h in P.CONCLUSION)}) as r from sa group by 1), y as (select * from x where p is not null and r is not null), {_gram_counts('y', 'doc_id', ('p', 'r'))}, sm as (select doc_id, sum(nb * na)::bigint as dot, sum(nb * nb)::bigint as abstract_square, sum(na * na)::bigint as conclusion_square from gc group by 1)", "select *, dot / (sqrt(abstract_square::double) * sqrt(conclusion_square::double)) as cosine from sm"),
        "section_architecture": pairs(f"{_facts()}, {_sections('after', 'sa')}, u as (select doc_id, {units('body')} as u from sa join facts using (doc_id) where key not in ('abstract', 'references') and not (level = 1 and n_sections > 1)), g as (select doc_id, count(*) as n, sum(u)::bigint as sum, sum(u * u)::bigint as squares, min(u) as min, max(u) as max from u group by 1)", f"select *, {_cv('n', 'sum', 'squares')} as cv from g"),
        "move_profiles": pairs(_profiles(), "select * from pr"),
        "profile_modes": pairs(_profiles() + ", pm as (select doc_id, profile, count(*) as n, min(pos) as f from pr group by 1, 2), pt as (select doc_id, profile as common_profile, n as common_count from pm qualify row_number() over (partition by doc_id order by n desc, f) = 1)", "select doc_id, count(*) as sections, any_value(common_profile) as common_profile, any_value(common_count) as common_count, count(*) filter (claim > 0 and boundary > 0) as claim_boundary, count(*) filter (claim > 0 and boundary > 0 and recommendation > 0) as all_three, sum(sentences)::bigint as sentences, sum(either)::bigint as either from pr join pt using (doc_id) group by 1"),
        "editorial_residue": pairs("z as (select 1)", _labelled("m", "doc_id", [(a, f"len(regexp_extract_all(after, {q('(?i)' + p)}))") for a, p in P.RESIDUE])),
        "source_placeholders": pairs("z as (select 1)", f"select doc_id, {squeeze('p')} as placeholder, count(*) as n from (select doc_id, unnest(list_concat({', '.join(f'regexp_extract_all(after, {q(chr(40) + chr(63) + chr(105) + chr(41) + p)})' for p in P.PLACEHOLDERS)})) as p from m) group by 1, 2"),
        "paragraph_geometry": pairs(_rollup(), "select * from rg"),
        "corrective_negation": pairs(_texture(), "select doc_id, pos, title, sentences, corrective from tx"),
        "section_closures": pairs(_texture(), "select doc_id, pos, closure_corrective, closure_judgement, closure_boundary from tx"),
    }
    out |= _guard(pairs) | _rules(pairs)
    return out
