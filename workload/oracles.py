"""The registered queries as DuckDB SQL over the same tables.

DuckDB's patterns know no look-around and see words as ASCII, so each rule is stated here in another way: look-alikes
are blanked first, boundaries are matched as characters.
"""

from __future__ import annotations

from hearthline import params as P
from hearthline.functions.text import PROMPT_HEADS, PROMPT_TAIL
from workload import views as V

ORACLES = {}

CLOCK = f"TIMESTAMP '{V.AS_OF_POSTS}'"
EVENTS_CLOCK = f"TIMESTAMP '{V.AS_OF_EVENTS}'"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ------------------------------------------------------------------------------------------ pieces
BLANKS = "[\\s \\x0b\\x1c-\\x1f\u0085  ]"
MARKS = "[‎‏‪-‮⁦-⁩]"
MARKERS = P.COMMENT_MARKERS


def strip(c):
    return f"regexp_replace(regexp_replace({c}, '^{BLANKS}+', ''), '{BLANKS}+$', '')"


def unmarked(c):
    return f"regexp_replace({c}, '{MARKS}', '', 'g')"


def post_text(c):
    u = unmarked(c)
    return (
        f"case when regexp_matches({u}, '{MARKERS}') then {strip(f'''regexp_replace({u}, '(?s)({MARKERS}).*', '')''')}"
        f" else {u} end"
    )


def model_input(c):
    a = f"regexp_replace({c}, 'https?://[^\\s ]+|www\\.[^\\s ]+', '', 'g')"
    b = f"regexp_replace({a}, '\\n{{2,}}', chr(10), 'g')"
    return strip(f"regexp_replace({b}, '[ \\t]{{2,}}', ' ', 'g')")


def hebrew_only(c):
    kept = f"regexp_replace({c}, '[^֐-׿0-9\\s .,\\-/\\\\''\"()\\[\\]]+', '', 'g')"
    return f"trim(regexp_replace({kept}, '[\\s ]{{2,}}', ' ', 'g'), ' ' || chr(9) || '-–—,/')"


def address_key(c):
    a = f"regexp_replace({c}, 'רמת[\\s-]?גן|גבעתיים|תל[\\s-]?אביב', '', 'g')"
    b = f"regexp_replace({a}, 'ר[\"״]?ג($|[^0-9A-Za-z_א-ת])', '\\1', 'g')"
    d = f"regexp_replace({b}, '[\",./\\-–—_]', ' ', 'g')"
    return f"case when {c} is null or {c} = 'לא צוין' then '' else trim(regexp_replace({d}, '\\s+', ' ', 'g')) end"


def cache_key(c):
    return f"nullif(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '')"


def excluded(t):
    return f"contains({t}, 'בני ברק')"


def shared(t):
    plain = f"replace(replace({t}, 'מיזוג', 'מי###'), 'זוגי', '###י')"
    return (
        f"(regexp_matches({t}, 'שות[פף]') and not regexp_matches({plain},"
        f" '(?s)זוג.{{0,30}}שות[פף]|שות[פף].{{0,30}}זוג'))"
    )


NEGATIVE = "סאבלט|סטודיו|קליניקה|מחפש|מחפשת|מחפשים|מחפשות"


def sale_match(t):
    return (
        f"coalesce(nullif(regexp_extract({t}, '(^|[^0-9])([1-9][0-9]{{0,2}}([.,][0-9]{{3}}){{2,}})($|[^0-9])', 2), ''),"
        f" nullif(regexp_extract({t}, '[1-9](\\.[0-9]+)?\\s*(מיליון|מליון)', 0), ''))"
    )


def target_rooms(t):
    return (
        f"regexp_matches({t}, '(^|[^0-9])(3|3\\.5)\\s*חד|שלוש[ה]?\\s*חד|שלוש[ה]?\\s*וחצי\\s*חד|(^|[^0-9])3\\s*וחצי\\s*חד')"
    )


def reason(t):
    return f"""case when {excluded(t)} then 'excluded_location:בני ברק'
     when {shared(t)} then concat('roommate_keyword:', regexp_extract({t}, 'שות[פף]', 0))
     when regexp_matches({t}, '{NEGATIVE}') then concat('negative_keyword:', regexp_extract({t}, '{NEGATIVE}', 0))
     when {sale_match(t)} is not null then concat('for_sale:', trim({sale_match(t)}))
     when not {target_rooms(t)} then 'room_count_mismatch' end"""


MARKER = "(₪|ש[\"״]?ח|שכ[\"״]?ד|שכר\\s*דירה|מחיר|לחודש)"


def candidates(t):
    sep = f"regexp_replace({unmarked(t)}, '([0-9])[.,\\s]([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g')"
    sep = f"regexp_replace({sep}, '([0-9])[.,\\s]([0-9]{{3}})($|[^0-9])', '\\1\\2\\3', 'g')"
    near = f"{MARKER}[^0-9]{{0,25}}[0-9]{{4,5}}\\b|(^|[^0-9])[0-9]{{4,5}}[^0-9]{{0,25}}{MARKER}"
    return f"list_transform(regexp_extract_all({sep}, '{near}', 0), lambda m: cast(regexp_extract(m, '[0-9]{{4,5}}', 0) as int))"


def price(p, cands):
    v = f"coalesce(cast({p} as double), 0)"
    fit = f"list_filter({cands}, lambda x: x between 5500 and 6700)[1]"
    return f"""cast(case when {v} between 5500 and 6700 then {v}
      when {p} is null and {fit} is not null then {fit}
      when ({v} < 3000 or {v} > 30000) and {cands}[1] is not null then {cands}[1] else {v} end as double)"""


def mentions(t):
    return (
        f"list_transform(regexp_extract_all({unmarked(t)}, '([1-9](?:\\.5)?)\\s*חד', 1), lambda m: cast(m as double))"
    )


def rooms(r, t):
    return f"""cast(case when {r} is not null then {r}
      else coalesce(list_filter({mentions(t)}, lambda x: x between 3.0 and 3.5)[1], 0) end as double)"""


def verdict(rooms_col, price_col, model_price):
    return f"""case when not ({rooms_col} between 3.0 and 3.5) then 'rejected_rooms'
      when {price_col} = 0 and {model_price} is null then 'price_unknown'
      when not ({price_col} between 5500 and 6700) then 'rejected_price' else 'added' end"""


def fee(c):
    digits = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    monthly = f"regexp_matches(replace({c}, 'לחודשיים', ''), 'לחודש')"
    return f"""case when {digits} <> '' then cast({digits} as bigint) * case when {monthly} then 2 else 1 end
      when contains({c}, 'כלול') then cast(0 as bigint) end"""


def floor(c):
    words = " ".join(f"when contains({c}, '{w}') then {n}" for w, n in P.FLOOR_WORDS)
    return f"case when regexp_matches({c}, '[0-9]') then cast(regexp_extract({c}, '[0-9]+', 0) as int) {words} end"


def agent(t, stated):
    return f"""case when regexp_matches({t}, 'ללא\\s+תיווך|לא\\s+מתיווך|בלי\\s+תיווך|לא\\s+תיווך') then {stated}
      when regexp_matches({t}, 'תיווך|נדל["״]?ן') then true else {stated} end"""


def parking(c):
    return f"""case when regexp_matches({c}, '(אין|בלי|ללא)\\s*חניה') or trim({c}) = 'אין' then 'לא'
      when regexp_matches({c}, 'פרטי|טאבו|מקור|צמוד|תת\\s*קרקעי|חניון') then 'פרטית'
      when regexp_matches({c}, 'רחוב|ציבור|חופשית') then 'ברחוב' end"""


def entry(c):
    h = hebrew_only(c)
    return f"coalesce(case when regexp_matches({h}, 'מיידי|מיד|עכשיו|היום') then 'מיידי' else {h} end, '')"


def clean_address(c, t):
    h = hebrew_only(f"coalesce({c}, '')")
    return f"""case when contains({h}, 'נמל התעופה') and not contains({t}, 'נמל התעופה') and not contains({t}, 'שדה תעופה')
      then '' else {h} end"""


CITY_ONLY = ", ".join(quoted(c) for c in P.CITY_ONLY)


def grade(c, result):
    """Confidence (result=0) or warning (result=1)."""
    values = [
        ("missing", P.WARN_MISSING), ("low", P.WARN_CITY_ONLY), ("missing", P.WARN_INVALID), ("high", ""),
        ("medium", P.WARN_LANDMARK), ("low", P.WARN_SHORT), ("medium", P.WARN_NO_STREET),
    ]
    v = [quoted(pair[result]) for pair in values]
    a = f"trim(coalesce({c}, ''))"
    return f"""case when {a} = '' then {v[0]} when {a} in ({CITY_ONLY}) then {v[1]}
      when not regexp_matches({a}, '[֐-׿]') then {v[2]}
      when regexp_matches({a}, '{P.STREET_WORDS}') or regexp_matches({a}, '[0-9]') then {v[3]}
      when regexp_matches({a}, '{P.LANDMARK_WORDS}') then {v[4]}
      when length({address_key(a)}) < 4 then {v[5]} else {v[6]} end"""


UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
UNIT_WORDS = "s|sec|secs|second|seconds|m|min|mins|minute|minutes|h|hr|hrs|hour|hours|d|day|days|w|wk|wks|week|weeks"


def relative(c, clock):
    t = strip(c)
    per = " ".join(f"when '{u}' then {n}" for u, n in UNITS.items())
    form = f"(?i)^([0-9]+)\\s*({UNIT_WORDS})$"
    unit = f"lower(substr(regexp_extract({t}, '{form}', 2), 1, 1))"
    return f"""case when lower({t}) = 'yesterday' then cast({clock} - interval 1 day as date)
      when regexp_matches({t}, '{form}') then
       (select case when s < 50000000000 then cast({clock} - to_seconds(cast(s as bigint)) as date) end
        from (select try_cast(regexp_extract({t}, '{form}', 1) as hugeint) * case {unit} {per} end as s) seconds) end"""


def day_month(day, month, clock, latest):
    def on(year):
        return f"cast(try_strptime({day} || '/' || {month} || '/' || ({year}), '%d/%m/%Y') as date)"

    now = f"year({clock})"
    return f"case when {on(now)} > {latest} then {on(f'{now} - 1')} else {on(now)} end"


def absolute(c, clock):
    form = "\\b([A-Za-z]+)\\s+([0-9]{1,2})\\b"
    months = " ".join(f"when '{m}' then '{n}'" for m, n in P.MONTHS.items())
    month = f"case lower(regexp_extract({c}, '{form}', 1)) {months} end"
    return day_month(f"regexp_extract({c}, '{form}', 2)", f"({month})", clock, clock)


def shown_date(c, clock):
    when = f"coalesce({relative(c, clock)}, {absolute(c, clock)})"
    return f"case when {when} is not null then strftime({when}, '%d/%m') else {c} end"


def inferred(c, clock):
    form = "^([0-9]{1,2})/([0-9]{1,2})$"
    part = [f"regexp_extract({c}, '{form}', {n})" for n in (1, 2)]
    return (
        f"case when regexp_matches({c}, '{form}') then"
        f" {day_month(part[0], part[1], clock, f'{clock} + interval 1 day')} end"
    )


def recent(d, clock):
    return f"coalesce(cast({d} as timestamp) >= {clock} - interval 21 day, true)"


POSTS, FIELDS, PUBLISHED = f"({V.POSTS}) posts", f"({V.FIELDS}) fields", f"({V.PUBLISHED}) published"
LOG = f"({V.VERDICT_LOG}) log"

# ------------------------------------------------------------------------------------------ text preparation
ORACLES["clean_documents"] = f"""
select doc_id, post, {model_input('post')} as model_input, replace(substr(post, 1, 100), chr(10), ' ') as snippet
from (select doc_id, {post_text(strip('raw'))} as post from ({V.NOISY_DOCUMENTS}) d where length({strip('raw')}) > 20) p"""

ORACLES["prompt_table"] = f"""
select doc_id, concat({quoted(PROMPT_HEADS['en'])}, {model_input('raw')}, {quoted(PROMPT_TAIL)}) as prompt
from ({V.NOISY_DOCUMENTS}) d"""

ORACLES["hebrew_text"] = f"select doc_id, {hebrew_only('raw')} as kept from ({V.NOISY_DOCUMENTS}) d"

ORACLES["address_keys"] = f"""
select post_no, {address_key('addr')} as listing_key, {cache_key('addr')} as cache_key,
 trim(replace(regexp_replace(split_part(addr, '__', 1), '(^|[^א-ת])רג($|[^א-ת])', '\\1רמת גן\\2', 'g'), 'גיבעתיים', 'גבעתיים')) as mended,
 case when regexp_matches(addr, 'רמת גן|גבעתיים|תל אביב|רמת-גן|ר"ג') then addr else addr || ', רמת גן, גבעתיים, ישראל' end as anchored
from (select post_no, coalesce(address_txt, 'לא צוין') || case post_no % 4 when 0 then '__extra' when 1 then '  רג  גיבעתיים' else '' end as addr
 from {FIELDS}) a"""

# ------------------------------------------------------------------------------------------ rules
ORACLES["rule_cascade"] = f"""
select post_no, case when reject_reason is not null then 'prefiltered' end as verdict, reject_reason
from (select post_no, {reason('text')} as reject_reason from {POSTS}) r"""

ORACLES["rule_hits"] = f"""
select post_no, {excluded('text')} as excluded_place, {shared('text')} as shared_flat,
 regexp_matches(text, '{NEGATIVE}') as disqualified, {sale_match('text')} is not null as for_sale,
 not {target_rooms('text')} as other_rooms, nullif(regexp_extract(text, '([1-9](?:\\.5)?)\\s*חד', 1), '') as found_rooms
from {POSTS}"""

DATED = f"(select *, {inferred('post_date', CLOCK)} as posted_on from (select *, {shown_date('date_txt', CLOCK)} as post_date from {FIELDS}) s) dated"

ORACLES["cascade_with_age"] = f"""
select coalesce(case when not {recent('posted_on', CLOCK)} then 'older_than_21_days' else {reason('text')} end, 'pass') as reason,
 count(*) as posts from {DATED} group by 1"""

# ------------------------------------------------------------------------------------------ repairs and verdict
ORACLES["price_repair"] = f"""
select post_no, model_price is null as price_missing, array_to_string(c, ',') as candidates, {price('model_price', 'c')} as price
from (select post_no, model_price, {candidates('text')} as c from {POSTS}) p"""

ORACLES["rooms_repair"] = f"""
select post_no, array_to_string(list_transform({mentions('text')}, lambda x: cast(x as varchar)), ',') as mentions,
 {rooms('model_rooms', 'text')} as rooms from {POSTS}"""

JUDGED = f"""(select *, case when why is not null then 'prefiltered' else {verdict('rooms_val', 'price_val', 'model_price')} end as verdict
 from (select post_no, group_url, model_price, why, case when why is null then {price('model_price', 'c')} end as price_val,
   case when why is null then {rooms('model_rooms', 'text')} end as rooms_val
  from (select *, {reason('text')} as why, {candidates('text')} as c from {POSTS}) a) b) judged"""

VERDICT_LIST = ", ".join(f"({n}, '{v}')" for n, v in enumerate(P.VERDICTS))

ORACLES["verdict_counts"] = f"""
select cast(v.position as int) as position, v.verdict, count(judged.post_no) as cnt
from (values {VERDICT_LIST}) v(position, verdict) left join {JUDGED} on judged.verdict = v.verdict group by 1, 2"""

ORACLES["verdict_rows"] = f"select post_no, verdict, price_val, rooms_val from {JUDGED}"

ORACLES["counts_by_verdict"] = f"select verdict, count(*) as cnt from {LOG} group by 1"

ORACLES["run_summary"] = f"""
select group_url, cast(grouping(group_url) as int) as is_total, count(*) as seen,
 count(*) filter (verdict = 'prefiltered') as prefiltered, count(*) filter (verdict <> 'prefiltered') as sent,
 count(*) filter (verdict = 'added') as added from {JUDGED} group by rollup (group_url)"""

# ------------------------------------------------------------------------------------------ fields
ORACLES["fees"] = f"""
select *, coalesce(vaad > 2400, false) as vaad_implausible, coalesce(arnona > 3000, false) as arnona_implausible
from (select post_no, {fee('arnona_txt')} as arnona, {fee('vaad_txt')} as vaad from {FIELDS}) f"""
ORACLES["floors"] = f"select post_no, {floor('floor_txt')} as floor from {FIELDS}"
ORACLES["agent_flags"] = f"""
select post_no, is_agent, case when is_agent then 'כן' when not is_agent then 'לא' else '' end as shown
from (select post_no, {agent('(text || agent_txt)', 'model_agent')} as is_agent from {FIELDS}) a"""
ORACLES["parking"] = f"select post_no, {parking('parking_txt')} as parking from {FIELDS}"
ORACLES["entry_dates"] = f"select post_no, {entry('entry_txt')} as entry_date from {FIELDS}"
ORACLES["address_class"] = f"""
select post_no, address, {grade('address', 0)} as confidence, {grade('address', 1)} as warning
from (select post_no, {clean_address('address_txt', "(text || case when post_no % 2 = 0 then ' ליד שדה תעופה' else '' end)")} as address
 from {FIELDS}) a"""
ORACLES["distances_checked"] = """
select event_id, meters, meters / 1000.0::double as km from (
 select event_id, case when event_id % 5 >= 3 then cast(floor(value * 100) as int) end as meters from events) m"""

# ------------------------------------------------------------------------------------------ dates
ORACLES["post_dates"] = f"""
select post_no, post_date as shown, posted_on,
 coalesce(date_txt <> '', false) and {relative('date_txt', CLOCK)} is null and {absolute('date_txt', CLOCK)} is null as unparsed,
 {recent('posted_on', CLOCK)} as recent from {DATED}"""
_UNIT_LIST = "['s', 'secs', ' minute', 'mins', ' hrs', 'H', ' day', 'd', 'w', ' wks', ' months', '']"
ORACLES["relative_dates"] = f"""
select event_id, {relative('raw', EVENTS_CLOCK)} as posted_on
from (select event_id, cast(case when event_id % 17 = 3 then event_id * 7000001 else event_id % 90 end as varchar)
 || case when event_id % 19 = 4 then repeat('0', 20) else '' end || {_UNIT_LIST}[cast(event_id % 12 + 1 as int)] as raw from events) e"""
ORACLES["unparsed_dates"] = f"""
select count(*) as unparsed, min(date_txt) as example from {FIELDS}
where date_txt <> '' and {relative('date_txt', CLOCK)} is null and {absolute('date_txt', CLOCK)} is null"""

# ------------------------------------------------------------------------------------------ extraction
_NUM = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def _typed(f):
    return f"json_type(response_json, '$.{f}')", f"json_extract_string(response_json, '$.{f}')"


_rt, _rv = _typed("rooms")
_pt, _pv = _typed("price")
_st, _sv = _typed("shelter")
_ft, _fv = _typed("floor")
_REAL = "regexp_matches(trim({v}), '^[+-]?[0-9]+(_[0-9]+)*(\\.[0-9]*)?([eE][+-]?[0-9]+)?$')"
READ = f"""(select *, (rt is null or rt = 'NULL' or rooms is not null) and (pt is null or pt = 'NULL' or price is not null)
  and (st is null or st = 'NULL' or shelter is not null) and (ft is null or ft = 'NULL' or ft = 'VARCHAR') as valid from (
 select post_no, {_rt} as rt, {_pt} as pt, {_st} as st, {_ft} as ft,
  case when {_rt} = 'BOOLEAN' then case {_rv} when 'true' then 1.0 else 0.0 end when {_rt} in {_NUM} then cast({_rv} as double)
   when {_rt} = 'VARCHAR' and {_REAL.format(v=_rv)} then cast(replace(trim({_rv}), '_', '') as double) end as rooms,
  case when {_pt} = 'BOOLEAN' then case {_pv} when 'true' then 1 else 0 end
   when {_pt} in {_NUM} and cast({_pv} as double) = floor(cast({_pv} as double)) then cast(cast({_pv} as double) as bigint)
   when {_pt} = 'VARCHAR' and regexp_matches(trim({_pv}), '^[+-]?[0-9]+(_[0-9]+)*(\\.0*)?$')
    then cast(cast(replace(trim({_pv}), '_', '') as double) as bigint) end as price,
  case when {_st} = 'BOOLEAN' then {_sv} = 'true' when {_st} in {_NUM} and cast({_sv} as double) in (0, 1) then cast({_sv} as double) = 1
   when {_st} = 'VARCHAR' and lower({_sv}) in ('1', 'on', 't', 'true', 'y', 'yes') then true
   when {_st} = 'VARCHAR' and lower({_sv}) in ('0', 'off', 'f', 'false', 'n', 'no') then false end as shelter,
  {_fv} as floor from ({V.RESPONSES}) r) f) read"""

ORACLES["json_validate"] = f"""
select post_no, valid, case when valid then cast(rooms as double) end as rooms, case when valid then price end as price,
 case when valid then shelter end as shelter, case when valid then floor end as floor from {READ}"""
ORACLES["record_json"] = f"""
select post_no, valid as answered, case when valid then cast(rooms as double) end as rooms, case when valid then floor end as floor from {READ}"""
ORACLES["first_valid"] = """
select conv_id, price, case when price is null then 'parse_failed' end as verdict from (
 select conv_id, case when n1 % 4 >= 2 then n1 when n1 % 4 = 0 and n2 % 4 >= 2 then n2 end as price from (
  select conv_id, max(length(text)) filter (turn = 0) as n1, max(length(text)) filter (turn = 1) as n2
  from conversations where turn in (0, 1) group by 1) t) u"""
ORACLES["parse_attempts"] = f"""
select url, cast(count(*) filter (verdict = 'parse_failed') as int) as attempts,
 count(*) filter (verdict = 'parse_failed') >= 3 as gave_up, max(ts) filter (verdict = 'parse_failed' and n = 3) as gave_up_at
from (select *, row_number() over (partition by url, verdict order by ts, seq) as n from {LOG}) l group by 1"""

# ------------------------------------------------------------------------------------------ state and joins
STATE = f"""(select url, arg_max(verdict, seq) as verdict, count(*) filter (verdict = 'parse_failed') as attempts from {LOG} group by 1) state"""
ORACLES["skip_processed"] = f"""
select ord, url from (select o_orderkey as ord, concat('https://example.test/u/', cast(o_custkey % 150 as string), '/',
  cast(o_orderkey % 10 as string)) as url from orders) feed
where not exists (select 1 from {STATE} where state.url = feed.url and (verdict <> 'parse_failed' or attempts >= 3))"""
LISTED = f"(select url from ({V.LISTED}) l)"
ORACLES["skip_published"] = f"select post_no, url from {POSTS} where url not in {LISTED}"
ORACLES["published_urls"] = f"select distinct url from {PUBLISHED} where url <> ''"

VERDICT_BY_NO = "[" + ", ".join(f"'{v}'" for v in P.VERDICTS) + "][cast(post_no % 7 + 1 as int)]"
FULL_STATE = f"""(select *, {VERDICT_BY_NO} as verdict, case when post_no % 10 <> 3 then text end as raw_text,
 cast(order_date as timestamp) as first_seen from {FIELDS}) full_state"""
RETRY = "('rejected_price', 'rejected_rooms', 'parse_failed', 'price_unknown', 'rejected_distance')"
ORACLES["retry_candidates"] = f"""
select url, verdict from {FULL_STATE} where verdict in {RETRY} and raw_text is not null and url not in {LISTED}"""
ORACLES["first_per_url"] = f"""
select url, seq, verdict from (select *, row_number() over (partition by url order by seq) as n from {LOG}) l where n = 1"""
ORACLES["upsert_posts"] = f"""
select url, arg_max(group_url, seq) as group_url, arg_max(verdict, seq) as verdict,
 cast(count(*) filter (verdict = 'parse_failed') as int) as attempts,
 min(run) as first_seen, max(run) as last_processed, arg_max(value, seq) as price_val
from (select *, case when ts < timestamp '2024-01-15 00:00:00' then timestamp '2024-01-15 00:00:00' else timestamp '2024-01-31 00:00:00' end as run
 from {LOG}) l group by 1"""
ORACLES["state_from_changes"] = ORACLES["upsert_posts"]
ORACLES["upsert_cache"] = f"""
select concat('street ', cast(seq % 700 as string)) as address_key, arg_max(url, ts) as original_address,
 arg_max(cast(floor(value) as int), ts) as distance_meters, max(ts) as updated_at from {LOG} group by 1"""
OLD = f"first_seen < {CLOCK} - interval 21 day"
ORACLES["retention"] = f"""
select url, case when {OLD} then null else raw_text end as raw_text, case when {OLD} then null else '{{}}' end as parsed_json, verdict
from {FULL_STATE}"""
ORACLES["retention_report"] = f"""
select count(*) filter ({OLD} and raw_text is not null) as lightened, count(*) as rows_kept from {FULL_STATE}"""
ORACLES["blank_invented"] = f"""
select url, case when coalesce(contains(address_txt, 'נמל התעופה'), false) then null else address_txt end as address,
 case when coalesce(contains(address_txt, 'נמל התעופה'), false) then null else cast(post_no % 6000 as int) end as distance_meters
from {FULL_STATE}"""

# ------------------------------------------------------------------------------------------ call budget
CALLS = """(select event_id as call_id, case when event_id % 3 = 0 then ts else ts + interval 20 days end as ts from events) calls"""
USAGE = f"(select strftime(ts, '%Y-%m') as month, count(*) as calls from {CALLS} group by 1) usage"
ORACLES["monthly_usage"] = f"select month, calls from {USAGE}"
ORACLES["upsert_usage"] = f"""
select strftime(ts, '%Y-%m') as month, count(*) as calls from (
 select o_orderdate as ts from orders union all select ts from events union all select ts from {CALLS}) t group by 1"""
ORACLES["quota_status"] = f"""
select month, calls as used, greatest(4000 - calls, 0) as remaining, calls >= 3200 as alert from {USAGE}"""
RANKED = f"""(select call_id, ts, strftime(ts, '%Y-%m') as month,
 row_number() over (partition by strftime(ts, '%Y-%m') order by ts, call_id) <= 3000 as allowed from {CALLS}) ranked"""
ORACLES["quota_skip"] = f"select call_id, month, allowed from {RANKED}"
ORACLES["quota_halt"] = f"""
select call_id, month from (select *, bool_and(allowed) over (order by ts, call_id rows unbounded preceding) as open from {RANKED}) r where open"""

# ------------------------------------------------------------------------------------------ addresses
PART = "{{'long_name': {n}, 'types': ['{t}', 'political']}}"
PARTS = "list_filter([" + ", ".join(
    PART.format(n=n, t=t)
    for n, t in (
        ("city3", "administrative_area_level_1"), ("city2", "administrative_area_level_2"), ("city1", "locality"),
        ("case when has_route then 'ביאליק' end", "route"),
    )
) + "], lambda x: x.long_name is not null)"
GOOD = (
    "{'types': ['street_address'], 'formatted_address': 'ביאליק, רמת גן', 'address_components':"
    " [{'long_name': 'רמת גן', 'types': ['locality', 'political']}]}"
)
GEOCODES = f"""(select cust, address_key, failed, list_slice([{{'types': [result_type], 'formatted_address': formatted,
  'address_components': {PARTS}}}, {GOOD}], 1, n_results) as results from ({V.GEOCODE_SRC}) s) geocodes"""


def names(best, kind):
    return f"list_transform(list_filter({best}.address_components, lambda x: list_contains(x.types, '{kind}')), lambda x: x.long_name)[1]"


def city(best):
    return f"coalesce({names(best, 'locality')}, {names(best, 'administrative_area_level_2')}, {names(best, 'administrative_area_level_1')}, '')"


def has_type(best, kinds):
    return f"len(list_filter({best}.address_components, lambda x: list_has_any(x.types, {kinds}))) > 0"


ALLOWED = "רמת גן|גבעתיים|תל אביב-יפו|תל אביב"
STATUS = """case when {asked} is null then 'quota' when failed then 'geocode_error' when best is null then 'not_found'
   when not (regexp_matches(best.formatted_address, '{ok}') or regexp_matches(city, '{ok}')) then 'wrong_city'
   when not (list_has_any(best.types, ['street_address', 'premise']) or {route}) then 'not_street_precision' else 'ok' end""".format(
    asked="results", ok=ALLOWED, route=has_type("best", "['route']")
)
GEO_WARNING = f"""case geocode_status when 'skipped_low_confidence' then {quoted(P.WARN_WEAK)} when 'quota' then {quoted(P.WARN_QUOTA)}
  when 'geocode_error' then {quoted(P.WARN_LOOKUP_ERROR)} when 'not_found' then {quoted(P.WARN_NOT_FOUND)}
  when 'wrong_city' then {quoted(P.WARN_WRONG_CITY)} when 'not_street_precision' then {quoted(P.WARN_IMPRECISE)} else '' end"""
GEO_CONFIDENCE = "case when geocode_status = 'ok' then 'high' when geocode_status in ('not_found', 'wrong_city', 'not_street_precision') then 'low' else {c} end"
BEST = f"(select *, {city('best')} as city from (select *, results[1] as best from {GEOCODES}) b) best_of"

ORACLES["geocode_accept"] = f"""
select address_key, case when geocode_status = 'geocode_error' then address_key when geocode_status = 'ok' then best.formatted_address else '' end as canonical_address,
 case when geocode_status in ('ok', 'wrong_city', 'not_street_precision') then city else '' end as city,
 {GEO_CONFIDENCE.format(c="'high'")} as geocode_confidence, {GEO_WARNING} as geocode_warning, geocode_status
from (select *, {STATUS} as geocode_status from {BEST}) s"""
LEVELS = "['route', 'street_address', 'premise', 'subpremise']"
ORACLES["street_precision"] = f"""
select address_key, city, best is not null and (list_has_any(best.types, {LEVELS}) or {has_type('best', LEVELS)}) as precise from {BEST}"""


def placed(source, carried):
    """Distance columns for rows of (address); ``carried`` names further columns of the source."""
    return f"""(select {carried}, address,
  case when short then null when cached then c_meters when distance_source = 'google_maps' then r_meters end as distance_meters, distance_source,
  case when short then false when cached then c_source = 'google_maps' else distance_source = 'google_maps' end as is_measured,
  case when short then 'missing' when cached then coalesce(nullif(c_confidence, ''), e20) when city_only then 'low' else g_confidence end as address_confidence,
  case when short then {quoted(P.WARN_MISSING)} when cached then c_warning when city_only then {quoted(P.WARN_CITY_ONLY)}
   when distance_source = 'google_maps_failed' then {quoted(P.WARN_NO_ROUTE)} when distance_source = 'google_maps_error' then {quoted(P.WARN_ROUTE_ERROR)}
   else coalesce(nullif(g_warning, ''), e20w) end as address_warning
 from (select *, case when short then 'skipped' when cached then 'cache' when city_only or g_confidence not in ('high', 'medium') then 'skipped'
   when r_status is null then 'quota' when r_status = 'OK' then 'google_maps' when r_status = 'ERROR' then 'google_maps_error' else 'google_maps_failed' end as distance_source
  from (select *, {GEO_CONFIDENCE.format(c='e20')} as g_confidence, {GEO_WARNING} as g_warning
   from (select *, case when e20 in ('missing', 'low') then 'skipped_low_confidence' else {STATUS} end as geocode_status
    from (select src.*, length(src.address) < 3 as short, {grade('src.address', 0)} as e20, {grade('src.address', 1)} as e20w,
      src.address in ({CITY_ONLY}) as city_only, g.failed, g.results, g.best, g.city, r.status as r_status, r.meters as r_meters,
      c.address_key is not null as cached, c.distance_meters as c_meters, c.distance_source as c_source, c.confidence as c_confidence, c.warning as c_warning
     from {source} src left join {BEST.replace(') best_of', ') g')} on g.address_key = {cache_key('src.address')}
     left join ({V.ROUTES}) r on r.address_key = {cache_key('src.address')}
     left join (select * from ({V.CACHE}) cc where distance_source in ('google_maps', 'skipped')) c on c.address_key = {cache_key('src.address')}
   ) j) k) l) m) placed"""


ADDRESSED = f"(select post_no, {hebrew_only(chr(39).join(('coalesce(address_txt, ', '', ')')))} as address from {FIELDS})"
PLACED = placed(ADDRESSED, "post_no")
ORACLES["distance_lookup"] = f"""
select post_no, distance_meters, distance_source, is_measured, address_confidence, address_warning from {PLACED}"""
ORACLES["distance_limit"] = f"""
select post_no, case when is_measured and distance_meters > 4000 then 'rejected_distance' else 'added' end as verdict from {PLACED}"""

REPAIR = f"""(select post_no, action, case action when 'updated' then best.formatted_address when 'blanked' then '' else address end as new_address,
  case action when 'updated' then round(meters / 1000.0, 3) when 'blanked' then null else (post_no % 100) / 10.0::double end as new_distance_km
 from (select *, case when coalesce(trim(address), '') = '' then 'unchanged' when contains(address, 'נמל התעופה') then 'blanked'
   when coalesce(failed, false) or not precise or locality is null then 'unresolved'
   when regexp_matches(locality, 'רמת גן|גבעתיים') then 'updated'
   when contains(locality, 'תל אביב') then case when meters <= 4000 then 'updated' else 'dropped' end else 'other_city' end as action
  from (select f.post_no, f.address_txt || case when f.post_no % 2 = 0 then '__old' else '' end as address, g.failed, g.best, g.locality,
    coalesce(g.precise, false) as precise, r.meters
   from {FIELDS.replace(') fields', ') f')} left join (select *, {names('best', 'locality')} as locality,
     best is not null and (list_has_any(best.types, {LEVELS}) or {has_type('best', LEVELS)}) as precise from {BEST}) g
    on g.address_key = f.address_txt
   left join (select * from ({V.ROUTES}) rr where status = 'OK') r on r.address_key = f.address_txt and g.best is not null) j) k) repair"""
ORACLES["address_repair"] = f"select post_no, action, new_address, cast(new_distance_km as double) as new_distance_km from {REPAIR}"
ORACLES["repair_report"] = f"""
select count(*) as total, count(*) filter (action = 'updated') as updated, count(*) filter (action = 'dropped') as removed,
 count(*) filter (action = 'unresolved') as unresolved, count(*) filter (action <> 'dropped') as rows_after from {REPAIR}"""

# ------------------------------------------------------------------------------------------ published table
BY_URL = f"""(select * from (select *, min(ord) over (partition by own) as pos, count(*) over (partition by own) as copies,
  row_number() over (partition by own order by post_date desc nulls last, ord) as n
 from (select *, case when url = '' then cast(ord as varchar) else url end as own from {PUBLISHED}) a) b where n = 1) by_url"""
BY_KEY = f"""(select url, ord, price, rooms, post_date, min(pos) over same as pos, cast(sum(copies) over same as bigint) as copies,
  row_number() over (same order by post_date desc nulls last, pos) as n
 from (select url, ord, price, rooms, post_date, pos, copies, case when length({address_key('address')}) >= 4
   then 'k' || {address_key('address')} || '|' || rooms || '|' || price else 'u' || own end as k from {BY_URL}) a window same as (partition by k)) by_key"""
KEPT = f"(select * from {BY_KEY} where n = 1) kept"
ORACLES["dedupe_url"] = f"select url, ord, pos, copies, post_date from {BY_URL}"
ORACLES["dedupe_listing"] = f"select url, ord, pos, copies from {KEPT}"
ORACLES["publish"] = f"""
select url, ord, post_date, price, rooms, pos from {KEPT} where {recent('post_date', CLOCK)}"""
ORACLES["publish_report"] = f"""
select cast(sum(copies) - count(*) as bigint) as duplicates_removed, count(*) filter (not {recent('post_date', CLOCK)}) as stale_removed,
 count(*) filter ({recent('post_date', CLOCK)}) as kept from {KEPT}"""


def _published_after(standing, batch, number):
    """The view after one more run: what stands and the run's rows, regrouped; ``place`` is a row's first position."""
    return f"""(select url, price, rooms, address, post_date, ord, place from (
 select url, price, rooms, address, post_date, ord, min(first) over (partition by k) as place,
  row_number() over (partition by k order by post_date desc nulls last, first) as nth
 from (select *, case when length({address_key('address')}) >= 4 then 'k' || {address_key('address')} || '|' || rooms || '|' || price else 'u' || url end as k
  from (select url, price, rooms, address, post_date, ord, min(place) over (partition by url) as first,
   row_number() over (partition by url order by post_date desc nulls last, place) as n
  from (select * from {standing} union all
   select case when url = '' then 'none/' || ord else url end, price, rooms, address, post_date, ord, {number}000000000000 + ord
   from {PUBLISHED} where batch = '{batch}') rows_of) by_url where n = 1) keyed) by_key
 where nth = 1 and {recent('post_date', CLOCK)}) run{number}"""


_NOTHING = "(select '' as url, 0 as price, 0.0 as rooms, '' as address, date '2000-01-01' as post_date, 0 as ord, 0 as place where false) nothing"
ORACLES["publish_delta"] = f"""
select url, cast(price as int) as price, cast(rooms as double) as rooms, address, post_date, timestamp '2001-01-01 00:00:00' + to_seconds(ord) as scanned_at
from {_published_after(_published_after(_published_after(_NOTHING, 'main', 0), 'again', 1), 'copy', 2)}"""

# ------------------------------------------------------------------------------------------ tables
ORACLES["staged_rewrite"] = f"select ord, url, post_date from {KEPT} where {recent('post_date', CLOCK)}"
ORACLES["snapshot_and_clear"] = f"""
select 'snapshot' as part, count(*) as n, cast(sum(ord) as bigint) as ord_sum from {PUBLISHED}"""
ORACLES["additive_migration"] = f"""
select verdict, count(*) as n, cast(0 as bigint) as prices, count(raw_text) as texts from {FULL_STATE} group by 1"""
ORACLES["page_links"] = """
select page_id, case page_id % 7 when 0 then 'https://example.test/groups/1/posts/' when 1 then 'https://other.test/marketplace/item/'
  when 2 then 'https://example.test/groups/2/permalink/' when 4 then 'relative/posts/' else 'https://example.test/groups/3/posts/' end || page_id as url,
 case page_id % 3 when 0 then '3 hrs' when 1 then 'July 9 & on' else '' end as post_date_text
from pages where page_id % 7 not in (1, 3, 5)"""
ORACLES["canonical_urls"] = "select page_id, split_part(url, '?', 1) as clean from pages"

# ------------------------------------------------------------------------------------------ jobs
FAILED_NO = "post_no % 17 = 5"


def job(rows, rules, with_age=False):
    """Records of a job over rows of the fields view: rules, failed answers, judgement, distance."""
    why = reason("text") if rules else "cast(null as varchar)"
    if with_age:
        why = f"case when not {recent('posted_on', CLOCK)} then 'older_than_21_days' else {why} end"
    judged = f"""(select *, case when why is not null then 'prefiltered' when {FAILED_NO} then 'parse_failed'
     else {verdict('rooms_val', 'price_val', 'model_price')} end as v1
    from (select *, why is null and not ({FAILED_NO}) as sent, case when why is null and not ({FAILED_NO}) then {price('model_price', 'c')} end as price_val,
     case when why is null and not ({FAILED_NO}) then {rooms('model_rooms', 'text')} end as rooms_val,
     {clean_address('address_txt', 'text')} as address
     from (select *, {why} as why, {candidates('text')} as c from {rows}) a) b)"""
    where = placed(
        judged,
        "post_no, url, posted_on, post_date, text, why, v1, price_val, rooms_val, arnona_txt, vaad_txt, floor_txt, parking_txt, entry_txt,"
        " model_agent, model_elevator",
    )
    return f"""(select *, coalesce(why, case when verdict in ('added', 'parse_failed') then '' else verdict end) as reject_reason,
   case when verdict in ('added', 'rejected_distance') then distance_meters end as shown_meters
  from (select *, case when v1 = 'added' and is_measured and distance_meters > 4000 then 'rejected_distance' else v1 end as verdict
  from {where}) x) job"""


FEED = DATED.replace("from (select *, case", "from (select * replace (text || agent_txt as text), case", 1)
NEW_FEED = f"""(select * from {FEED} where url not in {LISTED}
 and not exists (select 1 from {FULL_STATE} where full_state.url = dated.url and full_state.first_seen < timestamp '1996-01-01 00:00:00'
  and (full_state.verdict <> 'parse_failed' or full_state.post_no % 4 >= 3))) new_feed"""
SCREENED = job(NEW_FEED, True, with_age=True)
ORACLES["screen"] = f"""
select url, verdict, reject_reason, price_val, rooms_val, shown_meters as distance_meters, posted_on from {SCREENED}"""
LISTING = f"""(select url, cast(price_val as int) as price, rooms_val as rooms, {entry('entry_txt')} as entry_date, {floor('floor_txt')} as floor,
 model_elevator as elevator, {parking('parking_txt')} as parking, {fee('arnona_txt')} as arnona, {fee('vaad_txt')} as vaad,
 cast(null as boolean) as shelter, {agent('text', 'model_agent')} as is_agent, posted_on as post_date, address, {CLOCK} as scanned_at
 from {SCREENED} where verdict = 'added') listing"""
ORACLES["screen_listings"] = f"select * from {LISTING}"


def tri(c):
    return f"case when {c} then 'כן' when not {c} then 'לא' else '' end"


ORACLES["feed_summary"] = f"""
select group_url, cast(grouping(group_url) as int) as is_total, cast(sum(seen) as bigint) as seen, cast(sum(pre) as bigint) as prefiltered,
 cast(sum(sent) as bigint) as sent, cast(sum(ok) as bigint) as added from (
 select group_url, 1 as seen, 0 as pre, 0 as sent, 0 as ok from {FEED}
 union all select concat('g', split_part(url, '/', 5)), 0, cast(verdict = 'prefiltered' as int), cast(verdict <> 'prefiltered' as int),
  cast(verdict = 'added' as int) from {SCREENED}) t group by rollup (group_url)"""


ORACLES["published_text"] = f"""
select url, cast(price as varchar) as price, entry_date, coalesce(cast(floor as varchar), '') as floor, {tri('elevator')} as elevator,
 coalesce(parking, '') as parking, coalesce(cast(arnona as varchar), '') as arnona, {tri('is_agent')} as is_agent,
 coalesce(strftime(post_date, '%d/%m'), '') as post_date, strftime(scanned_at, '%Y-%m-%d %H:%M') as scanned_at from {LISTING}"""
ORACLES["analysis_columns"] = f"""
select url, price_val, rooms_val, case when v1 = 'added' then address end as address,
 case when v1 = 'added' then address_confidence end as address_confidence, post_date, reject_reason from {SCREENED}"""

STORED = f"(select full_state.* replace (raw_text as text), coalesce(date_txt, '') as post_date, {inferred('date_txt', CLOCK)} as posted_on from {FULL_STATE} where raw_text is not null)"
ORACLES["reprocess"] = f"""
select url, verdict, price_val, rooms_val, shown_meters as distance_meters
from {job(f"(select * exclude (verdict) from {STORED} st where verdict in {RETRY} and url not in {LISTED})", False)}"""
ORACLES["replay"] = f"""
select url, verdict, reject_reason, price_val, rooms_val, shown_meters as distance_meters
from {job(f"(select * exclude (verdict) from {STORED} st)", True)}"""
ORACLES["maintain"] = f"""
select 'listings' as part, count(*) as n, cast(sum(ord) as bigint) as "check" from {KEPT} where {recent('post_date', CLOCK)}
union all select 'state', count(raw_text), cast(sum(length(raw_text)) as bigint) from (select case when {OLD} then null else raw_text end as raw_text from {FULL_STATE}) s"""
ORACLES["stream_screen"] = f"""
select url, verdict, cast(case when verdict = 'parse_failed' then 1 else 0 end as int) as attempts, price_val, rooms_val
from {job(FEED, True, with_age=True)}"""
ORACLES["stream_state"] = f"""
select url, verdict, cast(case when verdict = 'parse_failed' then 2 else 0 end as int) as attempts, price_val, rooms_val
from {job(FEED, True, with_age=True)}"""

# ------------------------------------------------------------------------------------------ stored tables after a run
ORACLES["store_repeat"] = ORACLES["stream_screen"]
ORACLES["store_compact"] = ORACLES["stream_screen"]
ORACLES["store_replay"] = f"""
select s.url, coalesce(r.verdict, s.verdict) as verdict, cast(s.post_no % 4 + coalesce(cast(r.verdict = 'parse_failed' as int), 0) as int) as attempts
from {FULL_STATE.replace(') full_state', ') s')} left join (
 select url, verdict from {job(f"(select * exclude (verdict) from {STORED} st)", True)}) r on r.url = s.url"""
ORACLES["store_commit"] = ORACLES["stream_screen"]
ORACLES["state_buckets"] = ORACLES["upsert_posts"]
ORACLES["store_retention"] = ORACLES["retention"]
ORACLES["store_maintain"] = f"""
select count(*) as urls, count(raw_text) as n, cast(sum(length(raw_text)) as bigint) as "check"
from (select case when {OLD} then null else raw_text end as raw_text from {FULL_STATE}) s"""
ORACLES["store_reprocess"] = f"""
select s.url, coalesce(r.verdict, s.verdict) as verdict, cast(s.post_no % 4 + coalesce(cast(r.verdict = 'parse_failed' as int), 0) as int) as attempts
from {FULL_STATE.replace(') full_state', ') s')} left join (
 select url, verdict from {job(f"(select * exclude (verdict) from {STORED} st where verdict in {RETRY})", False)}) r on r.url = s.url"""
ORACLES["lookup_requests"] = f"""
select address_key, case when regexp_matches(a, 'רמת גן|גבעתיים|תל אביב|רמת-גן|ר"ג') then a else a || ', רמת גן, גבעתיים, ישראל' end as query
from (select {cache_key('src.address')} as address_key, min(src.address) as a from {ADDRESSED} src where length(src.address) >= 3 group by 1) d
where address_key is not null and {grade('a', 0)} not in ('missing', 'low') and trim(a) not in ({CITY_ONLY})
 and address_key not in (select address_key from ({V.CACHE}) c where distance_source in ('google_maps', 'skipped'))
order by address_key limit 500"""
ORACLES["text_files"] = "select md5(text) as digest, count(*) as n from documents group by 1"
