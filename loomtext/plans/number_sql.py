"""The fold over spoken numbers as recursive SQL, for DuckDB: what ``functions.numbers`` is held against.

A text becomes words, words become runs of number words, and one step of the recursion reads the next
word of every run. Whole numbers are 128-bit integers here, so amounts stay below 10^38.
"""

from __future__ import annotations

from ..functions import numbers

_NUMERAL = r"\p{Nd}+(\.\p{Nd}+)?"
_SIGNS = "-+£€$¢"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def regexp(expr: str, pairs: list[tuple[str, str]]) -> str:
    """Replacements in order; RE2 writes groups with a backslash."""
    for pattern, to in pairs:
        for k in "123":
            to = to.replace(f"${k}", f"\\{k}")
        expr = f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
    return expr


def _halves() -> list[tuple[str, str]]:
    """RE2 doesn't look behind, so the white space before a word is taken along."""
    half = r"(?:\band\s+a\s+half\b\s*)+"
    words = "|".join(sorted(numbers.HALF_AFTER))
    return [(rf"^\s*{half}", ""), (rf"(^|\s)({words})\s*{half}", "$1$2 point five "), (rf"(\S+)\s*{half}", "$1 and a half ")]


def _lexicon() -> str:
    rows = ", ".join(f"({_quoted(w)}, {_quoted(k)}, {_quoted(str(v))}, {_quoted(e)})" for w, (k, v, e) in numbers.LEXICON.items())
    return f"(values {rows}) as v(word, kind, value, ending)"


def standardized(source: str, text: str, into: str) -> str:
    """A query: the columns of the query ``source`` (whose rows are distinct by nothing in particular) and ``into``."""
    spaced = regexp(regexp(text, _halves()), numbers.SPACED)
    whole = lambda x: f"regexp_full_match({x}, '[0-9]+(\\.0*)?')"
    # shorthands over a state (s) and a token (t)
    flush_out = "case when s.amount is not null then s.out || ' ' || s.sign || s.amount else s.out end"
    flush_sign = "case when s.amount is not null then '' else s.sign end"
    emit = lambda what: f"s.out || ' ' || s.sign || {what}"
    flush_emit = lambda what: f"({flush_out}) || ' ' || ({flush_sign}) || {what}"
    digits = "(case when s.amount is null or (s.exact and s.amount = '0') then '' else s.amount end)"
    room = "(case when t.kind like 'ten%' or length(t.value) > 1 then 100 else 10 end)"
    spelled = "(t.kind like 'unit%' and (not s.exact or t.before = 'unit'))"
    fits = f"(s.exact and not {spelled} and try_cast(s.amount as hugeint) % {room} = 0)"
    joined = f"""(case when s.amount is null then t.value when {spelled} and t.before = 'ten' and length(t.value) = 1 then left(s.amount, -1) || t.value
      when {fits} then (try_cast(s.amount as hugeint) + t.value::hugeint)::varchar else s.amount || t.value end)"""
    joined_exact = f"(s.amount is null or {fits})"
    part = "rtrim(case when contains(s.amount, '.') then split_part(s.amount, '.', 2) else '' end, '0')"
    zeros = "(length(t.value) - 1)"
    times = f"""(case when s.amount is null then t.value
      when s.exact and s.amount <> '0' then (try_cast(s.amount as hugeint) // 1000 * 1000 + try_cast(s.amount as hugeint) % 1000 * t.value::hugeint)::varchar
      when regexp_full_match(s.amount, '[0-9]+\\.?[0-9]*|\\.[0-9]+') and length({part}) <= {zeros}
        then regexp_replace(split_part(s.amount, '.', 1) || rpad({part}, {zeros}::int, '0'), '^0+([0-9])', '\\1') end)"""
    product = f"coalesce({times}, t.value)"
    pend_point = "(s.amount is not null and not s.exact and s.amount like '%.')"
    bare = f"(case when t.kind = 'signed' then substr(t.word, 2) else t.word end)"
    bare_whole = f"(case when {whole(bare)} then regexp_replace(split_part({bare}, '.', 1), '^0+([0-9])', '\\1') end)"
    keep_and = "(t.goes_on and t.word = 'and' and t.before = 'power')"
    point = "(t.goes_on and t.word = 'point')"
    doubled = "(t.goes_on and t.word in ('double', 'triple') and t.after_kind in ('unit', 'zero'))"
    as_percent = "(t.kind = 'percent' and s.amount is not null and (t.word = 'percent' or t.after = 'cent'))"
    amount = f"""case when s.skip then s.amount
      when t.kind in ('numeral', 'signed') then case when {pend_point} then s.amount || t.word else coalesce({bare_whole}, {bare}) end
      when t.kind = 'zero' then {digits} || '0'
      when t.kind in ('unit', 'ten') then {joined}
      when t.kind = 'power' then {product}
      when t.kind = 'special' and {keep_and} then s.amount
      when t.kind = 'special' and {point} then case when t.decimal then {digits} || '.' else s.amount end
      when t.kind = 'special' and {doubled} then {digits} || repeat(t.after_value, case when t.word = 'double' then 2 else 3 end) end"""
    exact = f"""case when s.skip then s.exact
      when t.kind in ('numeral', 'signed') then not {pend_point} and {bare_whole} is not null
      when t.kind in ('unit', 'ten') then {joined_exact}
      when t.kind = 'power' then true
      when t.kind = 'special' and ({keep_and} or ({point} and not t.decimal)) then s.exact else false end"""
    sign = f"""case when s.skip then s.sign
      when t.kind in ('numeral', 'signed') then case when {pend_point} then s.sign when t.kind = 'signed' then left(t.word, 1) else {flush_sign} end
      when t.kind in ('zero', 'unit', 'ten') then s.sign
      when t.kind = 'power' then case when {times} is null then {flush_sign} else s.sign end
      when t.kind = 'sign' then case when t.goes_on then t.value else '' end
      when t.kind = 'special' and ({keep_and} or {point} or {doubled}) then s.sign else '' end"""
    out = f"""case when s.skip then s.out
      when t.kind in ('numeral', 'signed') then case when {pend_point} then s.out else {flush_out} end
      when t.kind in ('zero', 'unit', 'ten') then s.out
      when t.kind in ('unit_end', 'ten_end') then {emit(f"{joined} || t.ending")}
      when t.kind = 'power' then case when {times} is null then {flush_out} else s.out end
      when t.kind = 'power_end' then case when {times} is null then {flush_emit("t.value || t.ending")} else {emit(f"{product} || t.ending")} end
      when t.kind = 'sign' then case when t.goes_on then {flush_out} else {flush_emit("t.word")} end
      when t.kind = 'currency' then case when s.amount is null then {emit("t.word")} else s.out || ' ' || t.value || s.amount end
      when {as_percent} then {emit("s.amount || '%'")}
      when t.kind = 'percent' and s.amount is null then {emit("t.word")}
      when t.kind = 'special' and ({keep_and} or {point} or {doubled}) then s.out
      else {flush_emit("t.word")} end"""
    skip = f"not s.skip and ((t.kind = 'percent' and s.amount is not null and t.word = 'per' and t.after = 'cent') or (t.kind = 'special' and {doubled}))"
    return f"""
select * exclude (__rid, __text, __read), case when __text is not null then {regexp("coalesce(__read, '')", numbers.CENTS)} end as {into} from (
  with recursive rows_ as materialized (select *, row_number() over () as __rid, {spaced} as __text from ({source})),
  split as (select __rid, list_filter(string_split_regex(__text, '\\s+'), lambda x: x <> '') as ws from rows_),
  words as (select __rid, unnest(ws) as word, generate_subscripts(ws, 1) as pos from split),
  known as (select w.__rid, w.pos, w.word, case when regexp_full_match(w.word, '{_NUMERAL}') then 'numeral' when regexp_full_match(w.word, '[{_SIGNS}]{_NUMERAL}') then 'signed' else l.kind end as kind,
    coalesce(l.value, '') as value, coalesce(l.ending, '') as ending, l.kind as lexical from words w left join {_lexicon().replace(' as v(', ' as l(')} on w.word = l.word),
  beside as (select *, coalesce(lag(lexical) over w, '') as before, coalesce(lead(word) over w, '') as after, coalesce(lead(lexical) over w, '') as after_kind, coalesce(lead(value) over w, '') as after_value,
      coalesce(lead(kind) over w, '') as next_kind, coalesce(lag(kind is not null) over w, kind is null) <> (kind is not null) as turned from known window w as (partition by __rid order by pos)),
  runs as (select *, sum(turned::int) over (partition by __rid order by pos) as run from beside),
  tokens as materialized (select *, row_number() over (partition by __rid, run order by pos) as k, next_kind = 'numeral' or after_kind <> '' as goes_on, next_kind = 'numeral' or after_kind in ('zero', 'unit', 'ten') as decimal
    from runs where kind is not null),
  fold as (
    select __rid, run, 0::bigint as k, null::varchar as amount, false as exact, '' as sign, false as skip, '' as out from tokens where k = 1
    union all
    select t.__rid, t.run, t.k, {amount}, {exact}, {sign}, {skip}, {out} from fold s join tokens t on t.__rid = s.__rid and t.run = s.run and t.k = s.k + 1),
  last as (select __rid, run, arg_max({flush_out.replace('s.', '')}, k) as read from fold group by 1, 2),
  plain as (select __rid, run, string_agg(word, ' ' order by pos) as read from runs where kind is null group by 1, 2),
  joined as (select __rid, string_agg(ltrim(read, ' '), ' ' order by run) as __read from (select * from last union all select * from plain) group by 1)
  select rows_.*, __read from rows_ left join joined using (__rid))"""
