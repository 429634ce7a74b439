"""Source rows of the registered queries, derived from the given tables.

Every statement here is read by Spark and by DuckDB alike, so both engines start from the same rows.  Arithmetic on keys
decides which case a row exercises; every row of the underlying table takes part.
"""

AS_OF_POSTS = "2001-08-02 10:30:00"
AS_OF_EVENTS = "2024-02-01 00:00:00"

_P = "(4500 + (o_orderkey * 37) % 3500)"
_P_TEXT = f"cast({_P} as string)"

# One post per order: text, the model's price and rooms, date.
POSTS = f"""
select k as post_no, c as cust,
 concat('https://example.test/groups/', cast(c % 7 as string), '/posts/', cast(k as string)) as url,
 concat('g', cast(c % 7 as string)) as group_url,
 concat(room_txt, ', ', price_txt, '. ', extra_txt) as text,
 case when k % 5 = 0 then null when k % 5 = 2 then 250 when k % 5 = 4 then 45000 else p end as model_price,
 case when k % 9 = 0 then null else cast(2.5 + (k % 4) * 0.5 as double) end as model_rooms,
 cast(o_orderdate as date) as order_date
from (select o_orderkey as k, o_custkey as c, o_orderdate, {_P} as p,
  case o_orderkey % 8 when 1 then '3.5 חדרים' when 2 then '4 חדרים' when 3 then 'שלושה חדרים'
    when 4 then '3 וחצי חדרים' when 5 then '13 חדרים' else 'דירת 3 חדרים' end as room_txt,
  case o_orderkey % 7
    when 0 then concat({_P_TEXT}, ' ₪ לחודש')
    when 1 then concat(cast(cast(floor({_P} / 1000) as int) as string), ',', lpad(cast({_P} % 1000 as string), 3, '0'), ' ₪')
    when 2 then concat('במקום ', {_P_TEXT}, ' רק ', cast(5200 + (o_orderkey * 37) % 3500 as string), ' ₪')
    when 3 then concat('מחיר: ', {_P_TEXT}, ' או ', cast(6000 + o_orderkey % 1500 as string), ' ₪')
    when 4 then 'טלפון 0500000000'
    when 5 then concat('₪', {_P_TEXT})
    else concat('2,', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ',000 ₪') end as price_txt,
  case o_orderkey % 11 when 0 then 'טוב לזוג או שותפים' when 1 then 'דרושה שותפה' when 2 then 'סאבלט'
    when 3 then 'בני ברק' when 4 then 'מיזוג, חדר לשותף' else 'פנוי' end as extra_txt
 from orders) src
"""

# The same posts with the other fields a model would return, and the feed's date text.
FIELDS = f"""
select p.*,
 case post_no % 8 when 0 then null when 1 then concat(cast(100 + post_no % 900 as string), ' לחודש')
   when 2 then concat(cast(300 + post_no % 500 as string), ' לחודשיים') when 3 then 'כלול במחיר'
   when 4 then '300-400' when 5 then '' when 6 then concat('1,', cast(100 + post_no % 900 as string), ' ש"ח לחודש')
   else 'לא ידוע' end as arnona_txt,
 case post_no % 6 when 0 then null when 1 then concat(cast(50 + post_no % 300 as string), ' לחודש')
   when 2 then concat(cast(1000 + post_no % 3000 as string), '') when 3 then 'ועד כלול' when 4 then '150.5' else 'אין' end as vaad_txt,
 case post_no % 10 when 0 then null when 1 then concat(cast(post_no % 20 as string), ' מתוך 20') when 2 then 'קרקע'
   when 3 then 'קומה שנייה' when 4 then 'עשירית' when 5 then '1 מעל קרקע' when 6 then 'גבוהה' when 7 then ''
   when 8 then ' 7 ' else 'ראשונה או שלישית' end as floor_txt,
 case post_no % 11 when 0 then null when 1 then 'אין' when 2 then 'אין חניה' when 3 then 'ללא  חניה' when 4 then 'חניה בטאבו'
   when 5 then 'ברחוב' when 6 then 'חניון ציבורי' when 7 then 'חופשית באזור' when 8 then 'יש' when 9 then ''
   else 'תת קרקעי' end as parking_txt,
 case post_no % 9 when 0 then null when 1 then 'מיידי' when 2 then '1.8' when 3 then 'כניסה מיידית!!' when 4 then 'ספטמבר ✨'
   when 5 then 'September ספטמבר' when 6 then ' - 15/9, ' when 7 then 'גמיש   מאוד' else '' end as entry_txt,
 case post_no % 13 when 6 then null when 7 then 'רמת גן' when 8 then 'ליד הפארק הלאומי' when 9 then 'שכונת שנקין, רמת-גן'
   when 10 then 'נמל התעופה' when 11 then 'Herzl St' when 12 then 'ר"ג מרכז'
   else concat('רחוב ביאליק ', cast(cust as string), ', רמת גן') end as address_txt,
 case post_no % 6 when 0 then ' תיווך' when 1 then ' ללא תיווך' when 2 then ' משרד נדל"ן' when 3 then ' לא מתיווך' else '' end as agent_txt,
 case post_no % 3 when 0 then null when 1 then true else false end as model_agent,
 case post_no % 4 when 0 then null when 1 then true else false end as model_elevator,
 case post_no % 10 when 0 then concat(cast(post_no % 40 as string), 'd') when 1 then 'Yesterday' when 2 then concat(cast(post_no % 7 as string), ' wks')
   when 3 then concat('July ', cast(1 + post_no % 33 as string), ' at 5:50 PM') when 4 then concat(cast(1 + post_no % 31 as string), '/', cast(1 + post_no % 12 as string))
   when 5 then null when 6 then 'Yesterday at 5:50 PM' when 7 then concat(cast(post_no % 50 as string), ' HRS')
   when 8 then 'Feb 29' else concat('sept ', cast(1 + post_no % 30 as string)) end as date_txt
from ({POSTS}) p
"""

# A published table with repeated URLs, cross-posts, empty URLs and unknown dates.
PUBLISHED = f"""
select ord, batch, url, price, rooms, address, post_date from (
 select post_no * 4 as ord, 'main' as batch, case when post_no % 29 = 0 then '' else url end as url,
  5500 + cust % 3 * 100 as price, 3.0 + (cust % 2) * 0.5 as rooms, address_txt as address,
  case when post_no % 23 = 7 then null else date '2001-08-02' - cast(post_no % 40 as int) end as post_date from ({FIELDS}) a
 union all
 select post_no * 4 + 1 as ord, 'again' as batch, concat(url, '/again') as url, 5500 + cust % 3 * 100 as price, 3.0 + (cust % 2) * 0.5 as rooms,
  address_txt as address, date '2001-08-02' - cast(post_no % 31 as int) as post_date from ({FIELDS}) b
 union all
 select post_no * 4 + 2 as ord, 'copy' as batch, url, 5600 as price, 3.5 as rooms, address_txt as address,
  date '2001-08-02' - cast(post_no % 25 as int) as post_date from ({FIELDS}) d
) t
"""

# What a run finds published: every published row; only cross-posts without an address keep the post's own URL.
LISTED = f"""
select case when batch = 'copy' and address is null then url else concat(url, '/listed') end as url from ({PUBLISHED}) p
"""

# Address lookups, one per customer: what a geocoder and a router would have answered.  Some were asked about another place.
_PLACE_OF = "concat('רחוב ביאליק ', cast(c_custkey as string), ', רמת גן')"
_CITY_OF = """case c_custkey % 12 when 2 then 'חיפה' when 4 then 'ישראל' when 5 then 'ישראל' when 6 then 'יפו' when 7 then 'חיפה' when 9 then 'גבעתיים' else 'רמת גן' end"""
GEOCODE_SRC = f"""
select c_custkey as cust, concat({_PLACE_OF}, case when c_nationkey = 8 then ' unasked' else '' end) as address_key,
 c_custkey % 12 = 1 as failed,
 case c_custkey % 12 when 0 then 0 when 1 then 0 when 7 then 2 else 1 end as n_results,
 case c_custkey % 12 when 3 then 'locality' when 4 then 'premise' when 6 then 'geocode' when 2 then 'route' else 'street_address' end as result_type,
 c_custkey % 12 in (2, 6) as has_route,
 case c_custkey % 12 when 2 then 'חיפה' when 4 then null when 5 then null when 6 then 'תל אביב-יפו' when 7 then 'חיפה' when 9 then 'גבעתיים' else 'רמת גן' end as city1,
 case c_custkey % 12 when 4 then 'גבעתיים' else null end as city2,
 case c_custkey % 12 when 5 then 'מחוז תל אביב' else 'מחוז' end as city3,
 concat('ביאליק ', cast(c_custkey as string), ', ', {_CITY_OF}) as formatted
from customer
"""

# Routes start at the canonical address, or at the address itself where there is none.
_ROUTE = """
 case c_custkey % 7 when 0 then 'ZERO_RESULTS' when 1 then 'ERROR' else 'OK' end as status,
 cast(500 + (c_custkey * 37) % 6000 as int) as meters
from customer
"""
_NO_ROUTE = "case when c_nationkey = 3 then ' unasked' else '' end"
ROUTES = f"""
select concat({_PLACE_OF}, {_NO_ROUTE}) as address_key, {_ROUTE}
union all select concat('ביאליק ', cast(c_custkey as string), ', ', {_CITY_OF}, {_NO_ROUTE}) as address_key, {_ROUTE}
"""

CACHE = f"""
select concat({_PLACE_OF}, case when c_acctbal > 6000 then '' else ' unasked' end) as address_key,
 {_PLACE_OF} as original_address,
 '' as canonical_address, '' as city,
 case c_custkey % 10 when 5 then 'low' when 6 then '' else 'high' end as confidence, 'w' as warning, '' as distance_text,
 case when c_custkey % 10 in (5, 7) then cast(null as int) else cast((c_custkey * 53) % 6000 as int) end as distance_meters,
 case c_custkey % 10 when 3 then 'google_maps_error' when 4 then 'quota' when 5 then 'skipped' else 'google_maps' end as distance_source, 'ok' as geocode_status
from customer
"""

# A log of processing results, several per URL: the events table read as such.
VERDICT_LOG = """
select concat('https://example.test/u/', cast(user_id as string), '/', cast(event_id % 10 as string)) as url, event_id as seq, ts,
 concat('g', cast(user_id % 5 as string)) as group_url,
 case event_type when 'view' then 'added' when 'click' then 'parse_failed' when 'error' then 'parse_failed'
  when 'signup' then 'rejected_price' else 'prefiltered' end as verdict,
 value
from events
"""

# Documents with marks, links, comment sections and blank runs put in.
NOISY_DOCUMENTS = """
select doc_id, lang,
 concat(case when doc_id % 3 = 0 then concat(chr(10), chr(160), ' ') else '' end,
  case when doc_id % 4 = 1 then '‎⁦' else '' end,
  case when doc_id % 5 = 2 then 'see https://example.test/a?b=c www.example.test ' else '' end,
  text,
  case when doc_id % 6 = 3 then concat(chr(10), chr(10), chr(10), 'a', chr(9), '  b') else '' end,
  case doc_id % 7 when 1 then 'View more comments 1 2' when 2 then ' View 12 replies' when 3 then concat('Write a public comment', chr(10), 'x')
   when 4 then 'Most relevant Write a comment' else '' end,
  case when doc_id % 8 = 5 then concat('  ', chr(9), chr(10)) else '' end) as raw
from documents
"""

# Pages with post links put in front.
LINKED_PAGES = """
select page_id, url as page_url,
 concat(case page_id % 7
  when 0 then '<a role="link" href="/groups/1/posts/9?comment_id=3">x</a><a role="link" href="/groups/1/posts/'
  when 1 then '<a href="https://other.test/marketplace/item/'
  when 2 then '<a href="/about">y</a><a href="/groups/8/posts/7">no role</a><a class="k" role="link" href="/groups/2/permalink/'
  when 3 then '<a role="link" href="/profile/' when 4 then '<a role=''link'' href="relative/posts/' when 5 then '<b>no link</b><i title="'
  else '<a href="/x"></a><a ROLE="link" href="/groups/3/posts/' end,
  cast(page_id as string), case when page_id % 2 = 0 then '?ref=1&amp;x=2' else '' end, '"> <span>',
  case page_id % 3 when 0 then '3 hrs' when 1 then 'July 9 &amp; on' else '' end, '</span></a>', html) as html
from pages
"""

# One model answer per post in many shapes, as JSON text.
RESPONSES = """
select post_no, url, concat('{', rooms_j, ', ', price_j, ', ', shelter_j, ', ', floor_j, ', "other": [1]}') as response_json from (
 select o_orderkey as post_no, concat('u', cast(o_orderkey as string)) as url,
  case o_orderkey % 9 when 0 then '"rooms": 3' when 1 then '"rooms": 3.5' when 2 then '"rooms": "3.5"' when 3 then '"rooms": null' when 4 then '"rooms": true'
   when 5 then '"rooms": " 1e1 "' when 6 then '"r": 1' when 7 then '"rooms": "many"' else '"rooms": "3_5"' end as rooms_j,
  case o_orderkey % 11 when 0 then '"price": 5500' when 1 then '"price": 5500.0' when 2 then '"price": "5500"' when 3 then '"price": "5_500"' when 4 then '"price": "5500.0"'
   when 5 then '"price": null' when 6 then '"price": 5500.5' when 7 then '"price": "5,500"' when 8 then '"price": ""' when 9 then '"price": [5500]' else '"price": -12' end as price_j,
  case o_orderkey % 8 when 0 then '"shelter": true' when 1 then '"shelter": 0' when 2 then '"shelter": 1.0' when 3 then '"shelter": "YES"' when 4 then '"shelter": "off"'
   when 5 then '"shelter": null' when 6 then '"shelter": 2' else '"shelter": " yes"' end as shelter_j,
  case o_orderkey % 5 when 0 then '"floor": "3"' when 1 then '"floor": null' when 2 then '"floor": ""' when 3 then '"floor": "קרקע"' else '"floor": 3' end as floor_j
 from orders) src
"""
