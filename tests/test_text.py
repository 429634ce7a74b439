from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from hearthline import params as P
from hearthline.functions import fields, text


def test_strip_equals_python(apply):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rng = random.Random(1)
    values = ["".join(rng.choices(blanks + list("אב1x"), k=rng.randint(0, 8))) for _ in range(400)] + [" ‎ a "]
    assert apply(text.strip, values) == [v.strip() for v in values]


def _post_text(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.v for r in text.with_post_text(df, "v").orderBy("i").collect()]


def test_marks_and_comment_sections(spark):
    values = [
        "a‎b‮c⁦d‏",
        "post \nView more comments 5500",
        "post\n\nView 3 replies x",
        " plain text stays ",
        "Write a public comment",
        "x Write a comment y",
        "Submit your first comment",
        "View repl",
        "keep \nMost relevant\nView more comments",
    ]
    want = ["abcd", "post", "post", " plain text stays ", "", "x", "", "View repl", "keep"]
    assert _post_text(spark, values) == want


def test_marks_are_those_of_the_pattern(spark):
    values = [None, "", "₪ 5", "\u200f\u2066", *(f"א{chr(i)}ב" for i in range(0x3000))]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    both = rows.select(text.drop_direction_marks(F.col("t")).alias("got"), F.regexp_replace("t", P.DIRECTION_MARKS, "").alias("want"))
    assert both.where("not (got <=> want)").count() == 0 and both.where("got = 'אב'").count() > 10


def test_model_input(apply):
    values = ["see https://a.b/c?d=1 and www.x.y now", "a\n\n\nb", "a \t  b", "\n x \n", "http://a b"]
    assert apply(text.model_input, values) == ["see and now", "a\nb", "a b", "x", "b"]


def test_prompt_keeps_the_model_window(apply):
    params = P.ScreenParams(prompt_chars=10)
    out = apply(lambda c: text.prompt(c, params), ["x" * 50])[0]
    assert out.endswith("x" * 10 + text.PROMPT_TAIL) and "x" * 11 not in out
    hebrew = apply(lambda c: text.prompt(c, P.ScreenParams(prompt_language="hebrew")), ["y"])[0]
    assert hebrew.startswith("קרא")


def test_snippet_and_length(apply):
    assert apply(lambda c: text.snippet(c, 5), ["a\nbcdefg"]) == ["a bcd"]
    assert apply(lambda c: text.long_enough(c, 20), [" " * 9 + "x" * 20 + "  ", "x" * 21]) == [False, True]


def test_hebrew_only(apply):
    values = ["September ספטמבר ✨", " - 15/9, ", "רחוב  Herzl הרצל 5", "abc", "", None, "א\tב"]
    assert apply(text.hebrew_only, values) == ["ספטמבר", "15/9", "רחוב הרצל 5", "", "", None, "א\tב"]


def test_address_keys(apply):
    values = ["רחוב הרצל 5, רמת גן", 'ביאליק 3 ר"ג', "לא צוין", None, "תל-אביב", "ברג 5", "דרך.השלום_7"]
    assert apply(text.address_key, values) == ["רחוב הרצל 5", "ביאליק 3", "", "", "", "ב 5", "דרך השלום 7"]
    assert apply(text.cache_key, ["  Herzl   ST\t5 ", " ", None, "a b"]) == ["herzl st 5", None, None, "a b"]


def test_spelling_and_anchor(apply):
    values = ["הרצל 5 רג__x__y", "גיבעתיים שיינקין 3", "ארג 5"]
    assert apply(text.repair_spelling, values) == ["הרצל 5 רמת גן", "גבעתיים שינקין 3", "ארג 5"]
    assert apply(text.anchored_address, ["הרצל 5", "הרצל 5 גבעתיים"]) == ["הרצל 5" + P.ANCHOR_SUFFIX, "הרצל 5 גבעתיים"]


def test_blank_runs_equal_plain_collapse(apply):
    rng = random.Random(2)
    values = ["".join(rng.choices(" \t\n abA", k=12)) for _ in range(300)]
    want = [" ".join(v.strip().lower().split()) or None for v in values]
    assert apply(text.cache_key, values) == want


def test_tri_state(apply):
    assert apply(text.tri_state, [True, False, None], "boolean") == ["כן", "לא", ""]


# ------------------------------------------------------------------------------------------ fields
def test_fees(apply):
    values = ["250 לחודש", "480 לחודשיים", "כלול במחיר", "300-400", "150.5", "", None, "לא ידוע", "1,600 לחודש כלול"]
    assert apply(fields.bimonthly_fee, values) == [500, 480, 0, 300400, 1505, None, None, None, 3200]


def test_floors(apply):
    values = ["3 מתוך 5", "קרקע", "1 מעל קרקע", "שנייה", "קומה שניה", "עשירית", "", None, "גבוהה", "שלישית או קרקע"]
    assert apply(fields.floor_number, values) == [3, 0, 1, 2, 2, 10, None, None, None, 0]


def test_parking(apply):
    values = ["אין", "אין חניה", "חניה בטאבו", "תת  קרקעי", "ברחוב", "חופשית", "יש", "", None, " אין ", "אין מידע, רחוב"]
    want = ["לא", "לא", "פרטית", "פרטית", "ברחוב", "ברחוב", None, None, None, "לא", "ברחוב"]
    assert apply(fields.parking_class, values) == want


def test_agent(spark):
    rows = [("תיווך", None), ("ללא תיווך", False), ("משרד נדל״ן", False), ("לא מתיווך, תיווך", None), ("פרטי", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s boolean")
    got = [r[0] for r in df.orderBy("i").select(fields.agent_flag(F.col("t"), F.col("s"))).collect()]
    assert got == [True, False, True, None, True]


def test_entry_dates(apply):
    values = ["כניסה מיידית!!", "1.8", "עכשיו now", None, "", "גמיש  מאוד"]
    assert apply(fields.entry_date_text, values) == ["מיידי", "1.8", "מיידי", "", "", "גמיש מאוד"]


def test_address_grades(apply):
    values = ["", "רמת גן", "Herzl 5", "רחוב הרצל", "הרצל 5", "ליד הפארק", "גבעתיים ב", "ביאליק", None]
    grades = apply(lambda c: fields.address_confidence(c)["confidence"], values)
    assert grades == ["missing", "low", "missing", "high", "high", "medium", "low", "medium", "missing"]


def test_invented_address(spark):
    rows = [("נמל התעופה", "דירה"), ("נמל התעופה", "ליד שדה תעופה"), ("הרצל 5", "דירה")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, t string")
    got = [r[0] for r in df.orderBy("i").select(fields.clean_address(F.col("a"), F.col("t"))).collect()]
    assert got == ["", "נמל התעופה", "הרצל 5"]


def test_meters(apply):
    assert apply(fields.finite_meters, ["12.7", "inf", "NaN", "far", None, "-3"]) == [12, None, None, None, None, -3]
    assert apply(lambda c: fields.km_text(c.cast("int")), ["1250", "0", None]) in (["1.3", "0.0", None], ["1.2", "0.0", None])


def _prices(value):
    """Plain statement of the candidate rule."""
    joined = re.sub(r"([0-9])[.,\s](?=[0-9]{3}(?![0-9]))", r"\1", value)
    numbers = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+", joined) if 4 <= m.end() - m.start() <= 5]
    marks = [(m.start(), m.end()) for m in re.finditer("₪|מחיר", joined)]
    out, used = [], 0
    starts = sorted({s for s, _ in numbers} | {s for s, _ in marks})
    for at in starts:
        if at < used:
            continue
        pair = None
        for ms, me in marks:
            after = [n for n in numbers if n[0] >= me and not re.search("[0-9]", joined[me : n[0]]) and n[0] - me <= 25]
            if ms == at and after:
                pair = (after[0], after[0][1])
        for n in numbers:
            if n[0] == at and pair is None:
                ends = [e for s, e in marks if s >= n[1] and s - n[1] <= 25 and not re.search("[0-9]", joined[n[1] : s])]
                if ends:
                    pair = (n, max(ends))
        if pair:
            out.append(int(joined[pair[0][0] : pair[0][1]]))
            used = pair[1]
    return out


def test_price_candidates_equal_plain_rule(apply):
    rng = random.Random(3)
    pieces = ["₪", "מחיר", "5500", "6,200", "12", "7200", " ", " או ", "0501234567", "x" * 20, "4,500,000", "\n"]
    values = ["".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(400)]
    got = apply(fields.price_candidates, values)
    assert got == [_prices(v) for v in values]


def test_price_repair(spark):
    params = P.ScreenParams()
    rows = [
        (6000.0, "מחיר 100", 6000.0),
        (None, "מחיר 9000 או 6000 ₪", 6000.0),
        (None, "₪ 9000", 9000.0),
        (None, "בלי", 0.0),
        (7200.0, "היה 6,500 עכשיו 7,200 ₪", 7200.0),
        (250.0, "מחיר 9000", 9000.0),
        (45000.0, "מחיר 6000", 6000.0),
        (0.0, "אין", 0.0),
        (31000.0, "אין", 31000.0),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p double, t string, want double")
    got = fields.with_repaired_price(df, F.col("p"), F.col("t"), params).orderBy("i").collect()
    assert [r.price_val for r in got] == [r[2] for r in rows]


def test_rooms_repair(spark):
    rows = [(None, "13 חדרים", 3.0), (None, "4 חדרים או 3.5 חד", 3.5), (2.0, "3 חדרים", 2.0), (None, "x", 0.0), (3.5, "3 חדרים", 3.5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p double, t string, want double")
    got = fields.with_repaired_rooms(df, F.col("p"), F.col("t"), P.ScreenParams()).orderBy("i").collect()
    assert [r.rooms_val for r in got] == [r[2] for r in rows]
