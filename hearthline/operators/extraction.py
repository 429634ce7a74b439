"""Model answers to validated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline import params as P
from hearthline import schemas
from hearthline.functions import lax, text


def with_prompt(feed: DataFrame, params: P.ScreenParams, column: str = "text") -> DataFrame:
    """Add the batch-inference input of each post."""
    return feed.withColumn("prompt", text.prompt(F.col(column), params))


def validated(
    rows: DataFrame, response: Column | str = "response_json", answered: str = "answered", record: str = "record"
) -> DataFrame:
    """Add ``answered`` (readable JSON at all) and ``record`` (NULL if one field is invalid).

    The record is strict as a whole and lax per field: unknown keys are ignored, a missing key is NULL.  Each step is
    a projection of its own, so that the text is parsed once, its members are found in one pass and each is read once.
    """
    fields = schemas.RECORD.fields
    kept = rows.columns
    parsed = rows.withColumn("_document", F.try_parse_json(response))
    opened = parsed.withColumn("_members", lax.members(F.col("_document"), [f.name for f in fields]))
    at = {f.name: F.col("_members").getField(f.name) for f in fields}
    kinds = opened.withColumns({f"_kind_{f.name}": F.schema_of_variant(at[f.name]) for f in fields})
    read = kinds.withColumns(
        {f"_is_{f.name}": lax.READERS[f.dataType](at[f.name], F.col(f"_kind_{f.name}")) for f in fields}
    )
    valid = F.col("_members").isNotNull()
    for f in fields:
        absent = F.coalesce(F.col(f"_kind_{f.name}") == "VOID", F.lit(True))
        valid = valid & (absent | F.col(f"_is_{f.name}").isNotNull())
    return read.select(
        *kept,
        (F.col("_document").isNotNull() & ~F.is_variant_null("_document")).alias(answered),
        F.when(valid, F.struct(*[F.col(f"_is_{f.name}").alias(f.name) for f in fields])).alias(record),
    )


def with_record(rows: DataFrame, params: P.ScreenParams, responses: str = "responses") -> DataFrame:
    """Add ``record``, the first valid one of a post's ordered array of answers.

    An invalid answer is followed by the next try, a missing or unreadable one ends the search; a try that is not
    needed is not parsed.
    """
    kept = [c for c in rows.columns if c != "record"]
    searching, found = F.lit(True), []
    for n in range(params.response_tries):
        answer = F.when(searching, F.get(responses, F.lit(n)))
        rows = validated(rows, answer, f"_answered{n}", f"_record{n}")
        found.append(F.col(f"_record{n}"))
        searching = F.col(f"_answered{n}") & F.col(f"_record{n}").isNull()
    return rows.select(*kept, F.coalesce(*found).alias("record"))


def first_valid_response(
    responses: DataFrame, params: P.ScreenParams, key: str = "url", order: str = "response_no"
) -> DataFrame:
    """One row per key from an answer log: the record of the first valid answer, else verdict 'parse_failed'.

    Answers are numbered from 1.  Only the allowed tries are shuffled, combined on the map side first.
    """
    tries = range(1, params.response_tries + 1)
    answers = validated(responses.filter(F.col(order).between(1, params.response_tries)))
    per_key = answers.groupBy(key).agg(
        *[
            F.first(F.when(F.col(order) == n, F.struct("answered", "record")), ignorenulls=True).alias(f"_try{n}")
            for n in tries
        ]
    )
    record = F.lit(None).cast(schemas.RECORD)
    for n in reversed(tries):
        one = F.col(f"_try{n}")
        record = F.when(one["record"].isNotNull(), one["record"]).when(one["answered"], record)
    return per_key.select(
        key,
        record.alias("record"),
        F.when(record.isNull(), F.lit(P.PARSE_FAILED)).alias("verdict"),
    )


def attempts_from_log(log: DataFrame, params: P.ScreenParams, key: str = "url", order=("ts", "seq")) -> DataFrame:
    """Failed attempts per key from a log of verdicts, and when the limit was reached.

    Ranks beyond the limit are cut inside the map tasks, so a key that fills the log is not gathered in one task.
    """
    failed = F.col("verdict") == P.PARSE_FAILED
    attempts = log.groupBy(key).agg(F.count_if(failed).cast("int").alias("attempts"))
    nth = Window.partitionBy(key).orderBy(*order)
    last_try = (
        log.filter(failed)
        .select(key, *order)
        .withColumn("_n", F.row_number().over(nth))
        .filter(F.col("_n") <= params.max_parse_attempts)
        .filter(F.col("_n") >= params.max_parse_attempts)
        .select(key, F.col(order[0]).alias("gave_up_at"))
    )
    return attempts.join(last_try, key, "left").withColumn("gave_up", F.col("attempts") >= params.max_parse_attempts)
