"""Mixing sources to target weights by temperature.

Source shares of the corpus's tokens are raised to an exponent between 0 and 1.  The exponent is bisected until the weights
reach a target entropy, and again, if needed, until no source is repeated more often than allowed.  The weights become a
token budget for each source, spent on blocks: every block is a permutation of the source's documents by a keyed hash, whole
blocks first, and of the last one as much as the budget holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Work

_WAYS, _ROUNDS, _BUCKETS, _SMALL = 32, 5, 4096, 10_000
WORD = r"[^ \t\n\x0B\f\r]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def keyed(seed: int, *parts: Column) -> Column:
    """A 60-bit number from a keyed digest of the parts."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def exponent(totals: DataFrame, holds: Callable[[float, float, float, float, float], bool]) -> float:
    """The largest exponent in steps of 32^-5 for which ``holds(alpha, z, s, top, low)``, which is true from 0 up to it.

    A section of 32 parts a round instead of two: five aggregates over the source table, each of fixed size, so the
    sources never leave the executors.  ``z``: sum of (t/top)^alpha; ``s``: sum of (t/top)^alpha ln(t/top).
    """
    top, low = totals.agg(F.max("tokens"), F.min("tokens")).first()
    start, step = 0, _WAYS**_ROUNDS
    log = F.log(F.col("tokens") / F.lit(float(top)))
    scale = _WAYS**_ROUNDS
    for _ in range(_ROUNDS):
        step //= _WAYS
        grid = [start + i * step for i in range(_WAYS + 1)]
        sums = [f(F.exp(F.lit(g / scale) * log)).alias(f"{n}{i}") for i, g in enumerate(grid) for n, f in (("z", F.sum), ("s", lambda x: F.sum(x * log)))]
        row = totals.agg(*sums).first()
        good = [g for i, g in enumerate(grid) if holds(g / scale, row[f"z{i}"], row[f"s{i}"], float(top), float(low))]
        start = min(max(good, default=0), scale)
        if start == scale:
            break
    return start / scale


def entropy_reaches(target: float) -> Callable[[float, float, float, float, float], bool]:
    return lambda alpha, z, s, top, low: math.log(z) - alpha * s / z >= target


def repeats_over(passes: float) -> Callable[[float, float, float, float, float], bool]:
    """True up to the exponent from which on the smallest source is repeated as often as allowed, or less."""
    if passes < 1:
        raise ValueError("every source is read once at least")
    return lambda alpha, z, s, top, low: (top / low) ** (1 - alpha) > passes


def blocks(
    docs: DataFrame,
    flatten: float = 0.5,
    target_entropy: float | None = None,
    max_passes: float = 4.0,
    seed: int = 20240522,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with ``mix_pass`` (from 0) and ``mix_at``: one row for every time a document is to be read.

    ``target_entropy`` (nats) of the source weights; by default the natural entropy plus ``flatten`` of the way to equal
    weights.  ``max_passes`` limits how often any source is read and wins where both can't be had.  The budget is what reads
    the largest source exactly once, so every document is kept and smaller sources are repeated.  Sorting by ``mix_at`` (0 to
    1) gives an order in which every stretch has the target weights.

    A null source is a source of its own.  Documents without a word (null and empty texts too) cost nothing and are left
    out.  Rows that repeat both id and source are picked together in a partial block, or not at all.  Columns of ``docs``
    stay as they are, whatever their names; an empty table gives no row.
    """
    work = Work(docs.sparkSession, "mixing")
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(
        carried, F.col(source_col).cast("string").alias("src"), F.col(id_col).cast("string").alias("key"), n_words(F.col(text_col)).alias("n")
    ).withColumn("pick", keyed(seed, F.col("src"), F.col("key")))
    bucket = F.shiftright("pick", 48).cast("int")
    sums = rows.where("n > 0").groupBy("src", bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    sums = work.put(sums, "sums")  # at most 4096 rows a source
    totals = work.put(sums.groupBy("src").agg(F.sum("n").alias("tokens")), "totals")
    many = totals.count()
    if not many:
        return docs.limit(0).withColumn("mix_pass", F.lit(0)).withColumn("mix_at", F.lit(0.0))
    top, low = map(float, totals.agg(F.max("tokens"), F.min("tokens")).first())
    if target_entropy is None:
        share = F.col("tokens") / F.lit(top)
        z, s = totals.agg(F.sum(share), F.sum(share * F.log(share))).first()
        natural = math.log(z) - s / z
        target_entropy = natural + flatten * (math.log(many) - natural)
    alpha = exponent(totals, entropy_reaches(target_entropy))
    over = repeats_over(max_passes)
    if over(alpha, 0, 0, top, low):
        alpha = min(1.0, exponent(totals, over) + _WAYS**-_ROUNDS)

    plan = totals.withColumn("passes", F.pow(F.lit(top) / F.col("tokens"), F.lit(1 - alpha)))
    plan = plan.withColumn("whole", F.floor("passes").cast("int"))
    plan = plan.withColumn("budget", F.floor((F.col("passes") - F.col("whole")) * F.col("tokens")).cast("long"))
    order = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("n").over(order)).join(plan.select(F.col("src").alias("s"), "budget"), F.col("src").eqNullSafe(F.col("s")))
    # The bucket in which the budget ends, and what is left of it there; then the last keyed hash that still fits.
    ends = ends.where("upto > budget").groupBy("src").agg(F.min(F.struct("bucket", (F.col("budget") - (F.col("upto") - F.col("n"))).alias("rest"))).alias("e"))
    ends = work.put(ends.select(F.col("src").alias("s"), "e.bucket", "e.rest"), "ends")
    ends_small = F.broadcast(ends) if many <= _SMALL else ends
    last = rows.join(ends_small, F.col("src").eqNullSafe(F.col("s")) & (bucket == F.col("bucket"))).where("n > 0")
    last = last.groupBy("s", "pick", "rest").agg(F.sum("n").alias("n"))
    fits = F.sum("n").over(Window.partitionBy("s").orderBy("pick").rowsBetween(Window.unboundedPreceding, 0))
    cut = last.withColumn("upto", fits).where("upto <= rest").groupBy("s").agg(F.max("pick").alias("cut"))
    full = ends.select(F.col("s"), (F.shiftleft(F.col("bucket").cast("long"), 48) - 1).alias("before"))
    cut = full.join(cut.withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")), "left").select("s", F.coalesce("cut", "before").alias("cut"))
    plan = plan.select(F.col("src").alias("p"), "passes", "whole").join(cut, F.col("p").eqNullSafe(F.col("s")), "left")
    plan = work.put(plan.select("p", "passes", "whole", "cut"), "plan")

    if many <= _SMALL:  # the plan has one row a source; counted, so its size is known before it is broadcast
        joined = rows.where("n > 0").join(F.broadcast(plan), F.col("src").eqNullSafe(F.col("p")))
    else:  # a source may hold any share of the rows: deal its documents to parts and give each part the plan
        parts = 64
        spread = plan.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = rows.where("n > 0").withColumn("mine", F.pmod("pick", F.lit(parts)).cast("int"))
        joined = dealt.join(spread, F.col("src").eqNullSafe(F.col("p")) & (F.col("mine") == F.col("part")))
    times = F.col("whole") + F.when(F.col("pick") <= F.col("cut"), 1).otherwise(0)
    read = joined.where(times > 0).withColumn("mix_pass", F.explode(F.sequence(F.lit(0), times - 1)))
    place = F.when(F.col("mix_pass") == F.col("whole"), F.col("pick")).otherwise(keyed(seed, F.col("src"), F.col("key"), F.col("mix_pass")))
    at = F.least((F.col("mix_pass") + place / F.lit(float(1 << 60))) / F.col("passes"), F.lit(1.0))
    return read.select("row", "mix_pass", at.alias("mix_at")).select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix_pass", "mix_at")), "mix_pass", "mix_at"
    )


def oracle(flatten: float = 0.5, max_passes: float = 4.0, seed: int = 20240522) -> str:
    """``doc_id, source, mix_pass`` of ``blocks`` over ``documents`` in DuckDB SQL."""
    scale = _WAYS**_ROUNDS

    def search(name: str, holds: str) -> str:
        out, step = f"{name}0 as (select 0 as g)", scale
        for r in range(_ROUNDS):
            step //= _WAYS
            out += f""",
{name}g{r} as (select g + i * {step} as g, (g + i * {step}) / {scale}.0::double as a from {name}{r}, range({_WAYS + 1}) t(i)),
{name}z{r} as (select g, a, sum(exp(a * ln(tokens / top))) as z, sum(exp(a * ln(tokens / top)) * ln(tokens / top)) as s
  from {name}g{r}, totals, ends group by all),
{name}{r + 1} as (select least({scale}, coalesce(max(g), 0)) as g from {name}z{r}, ends, goal where {holds})"""
        return out

    return f"""
with d as (
  select doc_id, source, n, ('0x' || substr(md5('{seed}:' || coalesce(source, '-') || ':' || coalesce(doc_id::varchar, '-')), 1, 15))::bigint as pick
  from (select doc_id, source, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) as n from documents) where n > 0),
totals as (select source, sum(n)::double as tokens from d group by source),
ends as (select max(tokens) as top, min(tokens) as low, count(*) as many from totals),
evenness as (select ln(sum(tokens / top)) - sum(tokens / top * ln(tokens / top)) / sum(tokens / top) as h from totals, ends),
goal as (select h + {flatten} * (ln(many) - h) as target from evenness, ends),
{search("e", "ln(z) - a * s / z >= target")},
{search("r", f"pow(top / low, 1 - a) > {max_passes}")},
chosen as (select case when pow(top / low, 1 - e{_ROUNDS}.g / {scale}.0::double) > {max_passes}
  then least(1.0, r{_ROUNDS}.g / {scale}.0::double + 1 / {scale}.0::double) else e{_ROUNDS}.g / {scale}.0::double end as alpha
  from e{_ROUNDS}, r{_ROUNDS}, ends),
plan as (select source as s, tokens, pow(top / tokens, 1 - alpha) as passes from totals, ends, chosen),
spent as (select *, sum(n) over (partition by source order by pick) as upto from d),
times as (select doc_id, source, floor(passes)::integer + (upto <= floor((passes - floor(passes)) * tokens))::integer as k
  from spent join plan on source is not distinct from s)
select doc_id, source, unnest(range(k))::integer as mix_pass from times
"""
