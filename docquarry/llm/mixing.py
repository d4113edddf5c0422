"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt by hash into blocks of about `block_chars`
code points. With integer weights w of sum P, block j (from 1) of a source may
start no earlier than slot floor((j - 1) * P / w) and must be placed before slot
ceil(j * P / w); earliest deadline first over these windows fills every slot and
keeps each source, after any number of slots, less than one block away from its
weight's share. The windows repeat after P slots, so one period is scheduled
once, as a fold over one row with a few numbers per source, and every block
finds its slot by arithmetic. A source that runs out leaves its slots empty; the
others keep their proportions.

Only DataFrame functions are used. Documents move once, for the final order;
a source with most of the documents is many blocks and so many sort keys.

Defined results: every row is kept; a null text counts as empty and takes part;
a null source is a source of its own; rows that repeat a key share a block and
are ordered by text; sources without a given weight get the least integer
weight, weights that are null or not above zero count likewise; extra columns
stay as they are, and where one has the name of an added column the added ones
get a leading underscore (`added`); an empty table stays empty.

The deviation is counted in blocks, whose code points vary: a block is a bucket
of a hash, and a document is never cut. The schedule's fold costs slots times
sources, on one row, so sources are meant to be thousands and not millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Beyond so many slots in a period, the schedule is joined without a broadcast.
BROADCAST_SLOTS = 200_000
#: Columns that are added.
ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot")


def _free(prefix: str, names: list[str]) -> str:
    """The prefix with as many leading underscores as no name begins with it."""
    while any(n.lower().startswith(prefix) for n in names):
        prefix = "_" + prefix
    return prefix


def added(columns: list[str]) -> tuple[str, ...]:
    """The names of the added columns beside the given ones."""
    names, taken = ADDED, {c.lower() for c in columns}
    while taken & set(names):
        names = tuple("_" + n for n in names)
    return names


def _source(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(name).cast("string")))


def _hash(key: str) -> Column:
    """60 bits of the key's md5, for an order and a deal that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def schedule(weights: DataFrame) -> DataFrame:
    """(_mix_source, _mix_weight, _mix_period, _mix_place, slot, release, deadline) of one period.

    `weights`: _mix_source and an integer _mix_weight of at least 1.
    """
    one = weights.agg(F.sort_array(F.collect_list(F.struct("_mix_source", "_mix_weight"))).alias("s"), F.sum("_mix_weight").alias("p")).where("p is not null")
    release = lambda j, w: F.floor((j - 1) * F.col("p") / w).cast("long")
    deadline = lambda j, w: F.ceil(j * F.col("p") / w).cast("long")

    def step(state: Column, t: Column) -> Column:
        open_ = F.transform(
            "s",
            lambda x, i: F.when(
                (F.get(state["next"], i) <= x["_mix_weight"]) & (release(F.get(state["next"], i), x["_mix_weight"]) <= t),
                F.struct(deadline(F.get(state["next"], i), x["_mix_weight"]).alias("d"), i.alias("i")),
            ),
        )
        chosen = F.array_min(open_)["i"]
        following = F.transform(state["next"], lambda n, i: F.when(i == chosen, n + 1).otherwise(n))
        return F.struct(following.alias("next"), F.concat(state["out"], F.array(F.struct(chosen.alias("i"), F.get(state["next"], chosen).alias("j")))).alias("out"))

    start = F.struct(F.transform("s", lambda x: F.lit(1).cast("long")).alias("next"), F.array().cast("array<struct<i:int,j:bigint>>").alias("out"))
    run = one.select("s", "p", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("p") - 1), start, step)["out"].alias("out"))
    slots = run.select("s", "p", F.posexplode("out").alias("slot", "o"))
    source = F.get("s", F.col("o.i"))
    return slots.select(
        source["_mix_source"].alias("_mix_source"), source["_mix_weight"].alias("_mix_weight"), F.col("p").alias("_mix_period"), F.col("o.j").alias("_mix_place"),
        F.col("slot").cast("long").alias("_mix_at"), release(F.col("o.j"), source["_mix_weight"]).alias("_mix_from"), deadline(F.col("o.j"), source["_mix_weight"]).alias("_mix_by"),
    )


def mix(docs: DataFrame, targets: dict[str | None, float] | None = None, power: float = 0.5, slots: int = 1000, block_chars: int = 65_536, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows in mixed order, with mix_block (from 1, in its source), mix_release, mix_deadline and mix_slot (from 0).

    `targets`: weight by source; without it a source's weight is its number of
    code points to the power of `power`. `slots`: about the length of a period.
    """
    names = added(docs.columns)
    p = _free("_m_", [*docs.columns, *names])
    size = F.length(text_or_empty(text)).cast("long")
    totals = docs.groupBy(_source(source).alias("_mix_source")).agg(F.sum(size).alias("_mix_chars"))
    if targets is None:
        share = F.pow(F.greatest(F.col("_mix_chars"), F.lit(1)).cast("double"), F.lit(power))
    else:
        named = F.create_map(*(F.lit(x) for k, v in targets.items() for x in (("" if k is None else f"={k}"), float(v)))) if targets else F.create_map().cast("map<string,double>")
        share = F.greatest(F.coalesce(F.element_at(named, F.col("_mix_source")), F.lit(0.0)), F.lit(0.0))
    totals = written(totals.withColumn("_mix_share", share), "mix-sources")
    whole = totals.agg(F.sum("_mix_share")).first()[0] or 1.0
    weights = totals.select(
        "_mix_source", F.greatest(F.lit(1), F.round(F.col("_mix_share") / whole * slots)).cast("long").alias("_mix_weight"), F.greatest(F.lit(1), F.ceil(F.col("_mix_chars") / block_chars)).cast("long").alias("_mix_blocks")
    )
    plan = written(schedule(weights.select("_mix_source", "_mix_weight")), "mix-schedule")
    period = int(weights.agg(F.sum("_mix_weight")).first()[0] or 0)
    small = (lambda d: F.broadcast(d)) if period <= BROADCAST_SLOTS else (lambda d: d)
    own = lambda d: d.withColumnsRenamed({c: p + c.removeprefix("_mix_") for c in d.columns})
    c = lambda name: F.col(p + name)
    rows = docs.withColumns({p + "source": _source(source), p + "hash": _hash(key)}).join(small(own(weights)), p + "source")
    rows = rows.withColumn(p + "block", F.pmod(c("hash"), c("blocks")))
    rows = rows.withColumn(p + "place", F.pmod(c("block"), c("weight")) + 1).drop(p + "blocks")
    rows = rows.join(small(own(plan.drop("_mix_weight"))), [p + "source", p + "place"])
    round_ = F.floor(c("block") / c("weight")).cast("long") * c("period")
    told = (c("block") + 1, round_ + c("from"), round_ + c("by"), round_ + c("at"))
    # the tie-breaker is computed before the rows move, so texts move only if they are asked for
    mixed = rows.withColumns(dict(zip(names, told))).withColumn(p + "tie", F.xxhash64(text_or_empty(text)))
    return mixed.orderBy(names[-1], p + "hash", p + "tie").select(*docs.columns, *names)


def schedule_sql(docs: str, power: float = 0.5, slots: int = 1000, block_chars: int = 65_536) -> str:
    """The same as common table expressions of DuckDB's SQL, to stand after WITH RECURSIVE; the last is `mixed`."""
    return f"""
mix_docs AS (
  SELECT *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS src,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM {docs}
), mix_totals AS (
  SELECT src, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, pow(CAST(greatest(sum(length(coalesce(text, ''))), 1) AS DOUBLE), {power}) AS share
  FROM mix_docs GROUP BY src
), mix_weights AS (
  SELECT src, CAST(greatest(1, round(share / (SELECT sum(share) FROM mix_totals) * {slots})) AS BIGINT) AS w,
    CAST(greatest(1, ceil(chars / {block_chars}.0)) AS BIGINT) AS blocks FROM mix_totals
), mix_one AS (
  SELECT list(struct_pack(src := src, w := w) ORDER BY src) AS s, CAST(sum(w) AS BIGINT) AS p FROM mix_weights
), mix_run(t, nxt, pick) AS (
  SELECT CAST(-1 AS BIGINT), [CAST(1 AS BIGINT) for x in s], CAST(NULL AS STRUCT(d BIGINT, i BIGINT)) FROM mix_one WHERE p IS NOT NULL
  UNION ALL
  SELECT t, [CASE WHEN k = pick.i THEN n + 1 ELSE n END for n, k in nxt], pick FROM (
    SELECT r.t + 1 AS t, r.nxt AS nxt, list_min([struct_pack(d := CAST(ceil(r.nxt[k] * o.p / x.w) AS BIGINT), i := CAST(k AS BIGINT)) for x, k in o.s
      if r.nxt[k] <= x.w AND floor((r.nxt[k] - 1) * o.p / x.w) <= r.t + 1]) AS pick
    FROM mix_run r, mix_one o WHERE r.t + 1 < o.p)
), mix_plan AS (
  SELECT o.s[r.pick.i].src AS src, o.s[r.pick.i].w AS w, o.p AS p, r.nxt[r.pick.i] - 1 AS j, r.t AS t FROM mix_run r, mix_one o WHERE r.t >= 0
), mix_placed AS (
  SELECT d.*, d.h % g.blocks AS block, g.w AS w FROM mix_docs d JOIN mix_weights g USING (src)
), mixed AS (
  SELECT d.* EXCLUDE (src, h, block, w), d.block + 1 AS mix_block, CAST(d.block // d.w * m.p + floor((m.j - 1) * m.p / m.w) AS BIGINT) AS mix_release,
    CAST(d.block // d.w * m.p + ceil(m.j * m.p / m.w) AS BIGINT) AS mix_deadline, CAST(d.block // d.w * m.p + m.t AS BIGINT) AS mix_slot
  FROM mix_placed d JOIN mix_plan m ON m.src = d.src AND m.j = d.block % d.w + 1
)"""
