from __future__ import annotations

import json

import pytest

from hearthline import params as P
from hearthline.functions import lax
from hearthline.operators import extraction

PARAMS = P.ScreenParams()

ACCEPTED = {
    "price": [(5500, 5500), (5500.0, 5500), ("5500", 5500), (" 5500 ", 5500), ("5500.0", 5500), ("5_500", 5500), (True, 1), (None, None), (-3, -3)],
    "rooms": [(3, 3.0), ("3.5", 3.5), (" 3.5 ", 3.5), ("1e1", 10.0), ("3_5", 35.0), (True, 1.0), (2.25, 2.25), ("inf", float("inf"))],
    "shelter": [(True, True), (0, False), (1, True), (1.0, True), ("0", False), ("TRUE", True), ("Yes", True), ("on", True), ("t", True), ("off", False)],
    "floor": [("3", "3"), ("", ""), (None, None), ("קרקע", "קרקע")],
}
REFUSED = {
    "price": [5500.5, "5500.5", "5,500", "1e3", "", [5500], {"a": 1}, "x"],
    "rooms": ["", "many", [3], "3,5", {}],
    "shelter": [2, "", " yes", "maybe", [True], 0.5],
    "floor": [480, True, ["3"], {"a": "b"}, 1.5],
}


def _read(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response_json string")
    return extraction.validated(df).orderBy("i").collect()


@pytest.mark.parametrize("field", list(ACCEPTED))
def test_accepted_values(spark, field):
    got = _read(spark, [json.dumps({field: v, "unknown": [1]}, ensure_ascii=False) for v, _ in ACCEPTED[field]])
    assert all(r.record is not None for r in got)
    assert [r.record[field] for r in got] == [want for _, want in ACCEPTED[field]]


@pytest.mark.parametrize("field", list(REFUSED))
def test_one_bad_field_rejects_the_record(spark, field):
    good = {"address": "הרצל 5", "elevator": True}
    got = _read(spark, [json.dumps({**good, field: v}) for v in REFUSED[field]])
    assert [r.record for r in got] == [None] * len(got) and all(r.answered for r in got)


def test_shapes(spark):
    got = _read(spark, ["{}", "[]", "3", '"x"', "null", "no json", None, '{"rooms": null}'])
    assert [r.record is not None for r in got] == [True, False, False, False, False, False, False, True]
    assert [r.answered for r in got] == [True, True, True, True, False, False, False, True]


GOOD, BAD, NONE = '{"price": 6000}', '{"price": "x"}', "oops"


@pytest.mark.parametrize(
    "answers,price",
    [([GOOD], 6000), ([BAD, GOOD], 6000), ([NONE, GOOD], None), ([BAD, BAD, GOOD], None), ([BAD], None), ([], None), ([BAD, NONE], None), ([GOOD, BAD], 6000)],
)
def test_second_try(spark, answers, price):
    df = spark.createDataFrame([("u", answers)], "url string, responses array<string>")
    record = extraction.with_record(df, PARAMS).first().record
    assert (record and record.price) == price
    rows = [("u", n + 1, a) for n, a in enumerate(answers)]
    if rows:
        log = spark.createDataFrame(rows, "url string, response_no int, response_json string")
        row = extraction.first_valid_response(log, PARAMS).first()
        assert (row.record and row.record.price) == price
        assert row.verdict == (None if price else P.PARSE_FAILED)


def test_record_json_keeps_every_key_and_script(spark):
    df = spark.createDataFrame([('{"address": "הרצל", "price": "6_000"}',)], "response_json string")
    read = extraction.validated(df)
    written = json.loads(read.select(lax.record_json(read.record)).first()[0])
    assert written["address"] == "הרצל" and written["price"] == 6000 and written["rooms"] is None and len(written) == 11


def test_attempts(spark):
    rows = [("a", n, P.PARSE_FAILED) for n in range(5)] + [("b", 1, P.PARSE_FAILED), ("b", 2, P.ADDED), ("c", 1, P.ADDED)]
    log = spark.createDataFrame(rows, "url string, seq int, verdict string")
    got = {r.url: r for r in extraction.attempts_from_log(log, PARAMS, order=("seq",)).collect()}
    assert {u: (r.attempts, r.gave_up, r.gave_up_at) for u, r in got.items()} == {
        "a": (5, True, 2), "b": (1, False, None), "c": (0, False, None),
    }


def test_members_are_found_in_one_pass(spark):
    """One read of the parsed answer for all members, and no type of the whole of it."""
    df = spark.createDataFrame([(0, "{}")], "i int, response_json string")
    shown = extraction.validated(df.repartition(2))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("try_variant_get(_document") == 1 and "schemaOfVariant(_document" not in shown


@pytest.mark.parametrize("number, price, rooms", [("9007199254740993", 9007199254740993, 9007199254740992.0), ("1e3", 1000, 1000.0), ("1.0", 1, 1.0)])
def test_numbers_by_their_kind(spark, number, price, rooms):
    [row] = _read(spark, [f'{{"price": {number}, "rooms": {number}}}'])
    assert (row.record.price, row.record.rooms) == (price, rooms)
