"""Quality classification by an interpolated modified Kneser-Ney n-gram model.

The model's units are characters, all code points told apart, in n-grams of four.
Every trusted text is counted: map tasks add up the n-grams of a few million
characters, and the counts are summed, discounted and joined with their contexts
and with the next lower order as sparse rows (context, symbol), so the model
grows with the distinct n-grams of the trusted texts. Below the lowest order all
code points of Unicode are equally likely. A model of at most BROADCAST_GRAMS
n-grams is sent to the executors; a larger one stays a sharded table, which is
joined with the distinct n-grams of the scored texts, and these with the chunks
of texts they are from. A document is kept if its perplexity is at most a
quantile of the trusted documents' perplexities in its language. For the
quantiles, trusted documents are scored by a model that hasn't seen them: each
half of them, by a hash of the id, by the model of the other half.

Defined results: a null or empty text has no perplexity and isn't kept; a null
language is a language of its own; a language without trusted texts takes the
quantile over all trusted texts; if all trusted texts are in one half, the model of
all of them scores them; if no text is trusted the model is uniform, there is no
threshold and every text with a perplexity is kept; repeated rows are
scored each; trusted ids that are null or unknown are ignored; texts of any length are
read whole; an empty table gives an empty one; extra columns are ignored. `symbols`, where given, tells only the `symbols - 1` most frequent code
points of the trusted texts apart.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import text_or_empty, written

ORDER = 4
#: Up to so many trusted ids are broadcast; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Up to so many n-grams of all orders are broadcast; more are joined by shuffle.
BROADCAST_GRAMS = 2_000_000
#: Characters that a task counts at a time.
BUFFER = 4_000_000
#: Characters of the texts that are joined with their n-grams at a time.
CHUNK = 1_000_000
#: Bits of a symbol: a code point plus one; 0 is what lies before a text.
BITS = 21
CODE_POINTS = 0x110000
#: Up to so many possible values are ranked by a table, more by sorting.
RANKED = 1 << 24


class Model(NamedTuple):
    """Of each order from 1: `grams` (h, c, p) and `contexts` (h, gamma); h holds the symbols before c.

    of: symbol by code point, if they aren't all told apart; symbols: how many there are.
    """

    of: np.ndarray | None
    symbols: int
    grams: list[DataFrame]
    contexts: list[DataFrame]


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def symbol_map(alphabet: list[int]) -> np.ndarray:
    """Symbol of each code point; 0 stands for any other and for what lies before a text."""
    of = np.zeros(CODE_POINTS, np.uint32)
    of[np.array(alphabet, np.int64)] = np.arange(1, len(alphabet) + 1)
    return of


def before(n: int) -> int:
    """Mask of the n - 1 symbols before an n-gram's last."""
    return (1 << BITS * (n - 1)) - 1


def ranked(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, all below `size`, in order, and each value's place among them."""
    if size > RANKED:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[values]


def grams(texts: list[str], of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams (h, c), the place among them of the one that ends at each character, texts in a row, and the texts' lengths."""
    pad = "\0" * (ORDER - 1)
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), lengths
    s = code_points([pad + t for t in texts])
    s = s + np.uint32(1) if of is None else of[s]
    starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    inside = np.ones(len(s), bool)
    for k in range(ORDER - 1):
        s[starts + k] = 0
        inside[starts + k] = False
    one, s = ranked(s, CODE_POINTS + 1)
    two, s = ranked(s[:-1].astype(np.int64) * len(one) + s[1:], len(one) ** 2)
    four, s = ranked((s[:-2].astype(np.int64) * len(two) + s[2:])[inside[ORDER - 1 :]], len(two) ** 2)
    a, b = (two[x].astype(np.int64) for x in divmod(four, len(two)))
    (a, b), (c, d) = (tuple(one[x].astype(np.int64) for x in divmod(y, len(one))) for y in (a, b))
    return (a << 2 * BITS) | (b << BITS) | c, d, s, lengths


def discounts(table: DataFrame) -> list[float]:
    """Of counts one, two, and three or more, from the numbers of n-grams that occur one to four times."""
    n1, n2, n3, n4 = table.agg(*(F.sum((F.col("a") == k).cast("long")) for k in (1, 2, 3, 4))).first()
    out = [0.5, 1.0, 1.5]
    if n1 and n2 and n3 and n4:
        y = n1 / (n1 + 2.0 * n2)
        out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.0), float(i)) for i, d in enumerate(out, 1)]


def _shorter(n: int) -> Column:
    return F.col("h").bitwiseAND(F.lit(before(n)).cast("long"))


def kneser_ney(counts: DataFrame, symbols: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(h, c, p) of every n-gram that occurs and (h, gamma) of every context, by order from 1; counts: (h, c, a)."""
    table, levels = counts, []
    for n in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(table)
        cut = F.when(F.col("a") == 1, d1).when(F.col("a") == 2, d2).otherwise(d3)
        shard = table.withColumn("d", cut)
        context = written(shard.groupBy("h").agg(F.sum("a").alias("s"), (F.sum("d") / F.sum("a")).alias("gamma")), "kn-contexts")
        levels.insert(0, (shard.join(context, "h").select("h", "c", ((F.col("a") - F.col("d")) / F.col("s")).alias("q"), "gamma"), context.select("h", "gamma")))
        if n > 1:
            # below the top, an n-gram counts by how many symbols precede it
            table = written(table.groupBy(_shorter(n - 1).alias("h"), "c").agg(F.count("*").alias("a")), "kn-counts")
    told: list[DataFrame] = []
    for n, (seen, _) in enumerate(levels, 1):
        if n == 1:
            lower, rows = F.lit(1.0 / symbols), seen
        else:
            rows = seen.withColumn("_h", _shorter(n - 1)).join(told[-1].select(F.col("h").alias("_h"), "c", F.col("p").alias("_p")), ["_h", "c"])
            lower = F.col("_p")
        told.append(written(rows.select("h", "c", (F.col("q") + F.col("gamma") * lower).alias("p")), "kn-grams"))
    return told, [c for _, c in levels]


def top_code_points(rows: DataFrame, n: int) -> list[int]:
    def characters(batches):
        seen = np.zeros(CODE_POINTS, np.int64)
        for batch in batches:
            seen += np.bincount(code_points(batch.column(0).to_pylist()), minlength=CODE_POINTS)
        some = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(seen[some])], names=["c", "n"])

    top = rows.mapInArrow(characters, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(n)
    return sorted(r["c"] for r in top.collect())


def gather(texts: DataFrame, text: str = "text", alphabet: list[int] | None = None, symbols: int = CODE_POINTS) -> Model:
    """The model of all texts of a table."""
    of = None if alphabet is None else symbol_map(alphabet)

    def count(batches):
        def counted(held):
            h, c, at, _ = grams(held, of)
            a = np.bincount(at, minlength=len(h))
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (h, c, a)], names=["h", "c", "a"])

        held, size = [], 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(t)
                size += len(t)
                if size >= BUFFER:
                    yield from counted(held)
                    held, size = [], 0
        yield from counted(held)

    rows = texts.select(text_or_empty(text).alias("_text"))
    counts = written(rows.mapInArrow(count, "h long, c long, a long").groupBy("h", "c").agg(F.sum("a").alias("a")), "kn-counts")
    return Model(of, symbols, *kneser_ney(counts, symbols))


def small(model: Model) -> list[tuple[np.ndarray, ...]] | None:
    """Of each order from 1: contexts, log gamma, n-grams by place of the context and symbol, log p; None if there are too many."""
    if sum(g.count() for g in model.grams) > BROADCAST_GRAMS:
        return None
    out = []
    with np.errstate(divide="ignore"):
        for seen, context in zip(model.grams, model.contexts, strict=True):
            context, seen = context.orderBy("h").toArrow(), seen.toArrow()
            h = context.column("h").to_numpy()
            key = (np.searchsorted(h, seen.column("h").to_numpy()) << BITS) | seen.column("c").to_numpy()
            by = np.argsort(key)
            out.append((h, np.log(context.column("gamma").to_numpy()), key[by], np.log(seen.column("p").to_numpy())[by]))
    return out


def _find(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted values, and whether the wanted are there."""
    if not len(values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
    return at, values[at] == wanted


def look_up(levels: list[tuple[np.ndarray, ...]], symbols: int, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """log p of n-grams: of the longest that occurs, and the weights of the longer contexts."""
    out, left = np.zeros(len(h)), np.arange(len(h))
    for n in range(ORDER, 0, -1):
        contexts, gamma, keys, p = levels[n - 1]
        at, known = _find(contexts, h[left] & before(n))
        place, found = _find(keys, (at << BITS) | c[left])
        found &= known
        out[left[found]] += p[place[found]]
        out[left[known & ~found]] += gamma[at[known & ~found]]
        left = left[~found]
    out[left] -= np.log(symbols)
    return out


def joined(model: Model, wanted: DataFrame) -> DataFrame:
    """The same by joins with the sharded model: (h, c) with lp; an n-gram comes once."""
    rows = wanted.withColumns({"lp": F.lit(0.0), "_open": F.lit(True)})
    log = lambda x: F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))
    for n in range(ORDER, 0, -1):
        seen = model.grams[n - 1].select(F.col("h").alias("_h"), "c", F.col("p").alias("_p"))
        context = model.contexts[n - 1].select(F.col("h").alias("_h"), F.col("gamma").alias("_g"))
        rows = rows.withColumn("_h", _shorter(n)).join(seen, ["_h", "c"], "left").join(F.broadcast(context) if n == 1 else context, "_h", "left")
        more = F.when(F.col("_p").isNotNull(), log(F.col("_p"))).when(F.col("_g").isNotNull(), log(F.col("_g"))).otherwise(0.0)
        rows = rows.select("h", "c", (F.col("lp") + F.when(F.col("_open"), more).otherwise(0.0)).alias("lp"), (F.col("_open") & F.col("_p").isNull()).alias("_open"))
    return rows.select("h", "c", (F.col("lp") - F.when(F.col("_open"), float(np.log(model.symbols))).otherwise(0.0)).alias("lp"))


def _scores(texts: list[str], of: np.ndarray | None, log_p) -> pa.Array:
    """Perplexities; log_p(h, c) of distinct n-grams."""
    h, c, at, lengths = grams(texts, of)
    ends = np.cumsum(lengths)
    each = log_p(h, c)[at]
    # minus infinity would spoil the running sums of later texts
    never = np.concatenate([[0], np.cumsum(np.isneginf(each))])
    run = np.concatenate([[0.0], np.cumsum(np.where(np.isneginf(each), 0.0, each))])
    with np.errstate(all="ignore"):
        out = np.exp(-(run[ends] - run[ends - lengths]) / lengths)
    out[never[ends] > never[ends - lengths]] = np.inf
    return pa.array([x if n else None for x, n in zip(out.tolist(), lengths.tolist(), strict=True)], pa.float64())


def perplexities(docs: DataFrame, model: Model, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The kept columns and each text's perplexity (null: no text)."""
    spark = docs.sparkSession
    rows = docs.select(*keep, text_or_empty(text).alias("_text"))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    result = f"{fields}, perplexity double"
    levels, of, symbols = small(model), model.of, model.symbols

    def runs(texts, limit):
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < limit):
                size += len(texts[j])
                j += 1
            yield i, j
            i = j

    if levels is not None:
        held = spark.sparkContext.broadcast(levels)

        def score(batches):
            for batch in batches:
                texts = batch.column(len(keep)).to_pylist()
                for i, j in runs(texts, BUFFER):
                    told = _scores(texts[i:j], of, lambda h, c: look_up(held.value, symbols, h, c))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), told], names=[*keep, "perplexity"])

        return rows.mapInArrow(score, result)

    def dealt(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            for i, j in runs(texts, CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * (j - i), pa.int64()), *(batch.column(c).slice(i, j - i) for c in range(1, len(keep) + 2))], names=["_chunk", *keep, "_text"])

    def need(batches):
        for batch in batches:
            ids, texts, i = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while i < len(ids):
                j = i
                while j < len(ids) and ids[j] == ids[i]:
                    j += 1
                h, c, *_ = grams(texts[i:j], of)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), ids[i], np.int64)), pa.array(h), pa.array(c)], names=["_chunk", "h", "c"])
                i = j

    arrow = to_arrow_schema(rows.select(*keep, F.lit(0.0).alias("perplexity")).schema)

    def told(texts: pa.Table, known: pa.Table) -> pa.Table:
        h, c, lp = (known.column(x).to_numpy() for x in ("h", "c", "lp"))
        by = np.lexsort((c, h))
        contexts, first = np.unique(h[by], return_inverse=True)
        keys, lp = (first << BITS) | c[by], lp[by]
        find = lambda h, c: lp[np.searchsorted(keys, (np.searchsorted(contexts, h) << BITS) | c)]
        got = _scores(texts.column("_text").to_pylist(), of, find)
        return pa.table([*(texts.column(x) for x in keep), got], names=arrow.names)

    chunks = written(rows.select(F.monotonically_increasing_id().alias("_chunk"), *keep, "_text").mapInArrow(dealt, f"_chunk long, {fields}, _text string"), "kn-chunks")
    wanted = written(chunks.select("_chunk", "_text").mapInArrow(need, "_chunk long, h long, c long"), "kn-wanted")
    known = written(joined(model, wanted.select("h", "c").distinct()), "kn-known")
    return chunks.groupBy("_chunk").cogroup(wanted.join(known, ["h", "c"]).groupBy("_chunk")).applyInArrow(told, result)


def train(texts: DataFrame, text: str = "text", symbols: int = 48) -> tuple[list[int], np.ndarray]:
    """(alphabet, log p of all its n-grams) of a model that tells `symbols` symbols apart; for small numbers."""
    alphabet = top_code_points(texts.select(text_or_empty(text).alias("_text")), symbols - 1)
    model = gather(texts, text, alphabet, symbols)
    g = np.arange(symbols**ORDER, dtype=np.int64)
    s = [g // symbols**k % symbols for k in range(ORDER)]
    return alphabet, look_up(small(model), symbols, (s[3] << 2 * BITS) | (s[2] << BITS) | s[1], s[0])


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, key: str = "doc_id", lang: str = "lang", text: str = "text", symbols: int | None = None) -> DataFrame:
    """key, lang, perplexity, threshold, kept. `trusted`: a table of the ids of trusted documents."""
    ids = trusted.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, key, "left_semi")
    texts = written(texts.select(key, lang, text_or_empty(text).alias("_text"), F.pmod(F.xxhash64(key, F.lit(41)), F.lit(2)).alias("_half")), "kn-trusted")
    alphabet = None if symbols is None else top_code_points(texts.select("_text"), symbols - 1)
    fitted = lambda rows: gather(rows, "_text", alphabet, CODE_POINTS if symbols is None else symbols)
    model = fitted(texts)
    scored = written(perplexities(docs, model, (key, lang), text), "kn-scores")
    halves = [texts.where(F.col("_half") == k) for k in (0, 1)]
    if any(h.where("_text <> ''").isEmpty() for h in halves):
        reference = scored.join(ids, key, "left_semi")
    else:
        one, other = (perplexities(halves[1 - k], fitted(halves[k]), (key, lang), "_text") for k in (0, 1))
        reference = written(one.unionByName(other), "kn-reference")
    reference = reference.where("perplexity is not null")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    own = reference.groupBy(F.coalesce(F.col(lang), F.lit("")).alias("_lang")).agg(at.alias("_own"))
    own = written(own, "kn-thresholds")  # one row a language: its size is known when the join is planned
    general = reference.agg(at).first()[0]
    told = scored.withColumn("_lang", F.coalesce(F.col(lang), F.lit(""))).join(own, "_lang", "left")
    told = told.withColumn("threshold", F.coalesce("_own", F.lit(general).cast("double")))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return told.select(key, lang, "perplexity", "threshold", kept.alias("kept"))
