"""Personal data: bases that patterns of characters find, and more from bootstrapped contexts.

Base spans are the matches of one regular expression a kind that also pass a
check (digits, Luhn). Beside them, mentions are read: strings in a form of a kind,
whether they pass or not, each with the words around it. Mentions that pass are
seeds. They induce lexical patterns, the words before a mention (one, two, three
of them, or one before and one after it), and a graph of patterns and instances
(a kind and a string) is scored in rounds: a pattern's confidence for a kind is
the lower end of the share of its distinct instances that are known to be of that
kind (Wilson's interval, so few instances prove little), an unknown instance's is
that of its best confident pattern. Patterns that reach `least` name unknown
instances, which count as far as they are trusted in the next round. What is
named, or passes the check by itself within a string that fails as a whole, is a
span wherever it occurs, unless a base span is there.

Everything is built-in functions and joins. Texts are read once, in time linear
to their length (possessive quantifiers and guards keep regular expressions from
going back), and only matches, with a few words each, go on. A pattern's instances
are counted as distinct pairs, so copies of a document prove nothing and frequent
words are summed in parts; pairs whose pattern can't reach `least` even if all
unknown instances were known are dropped before the rounds.

Defined results: a null text is empty and has no spans; every row has a result,
rows that repeat a doc_id each their own; an empty table gives an empty one; extra
columns are ignored, whatever their names. Positions are code points, ends
exclusive. Spans of one kind never overlap; added spans overlap no base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_or_empty, written

#: Patterns and answers up to this number are broadcast, more are joined by shuffle.
BROADCAST_PATTERNS = 50_000
#: Code points around a mention from which its words are taken.
AROUND = 64
#: A pattern's confidence is the lower end of an interval of this many standard deviations.
SIGMAS = 1.64

KINDS = ("email", "ip", "card", "phone")

#: Fixed forms of the bases, written so that no part is read twice.
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASES = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms of mentions, the first that fits counts. An address may be spelt out, numbers may lack a sign or fail a check.
_HOST = r"[A-Za-z0-9-]{1,63}"
_DOT = r"(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)"
FORMS = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:@{_HOST}(?:{_DOT}{_HOST}){{0,8}}|\x20?(?:\(at\)|\[at\]|\{{at\}})\x20?{_HOST}(?:{_DOT}{_HOST}){{0,8}}|\x20at\x20{_HOST}(?:\x20dot\x20{_HOST}){{1,8}})",
    "ip": r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])|(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:]))",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+?[0-9]{7,15}(?![0-9A-Za-z])|(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,5}(?![0-9])(?:[\x20.-][0-9]{2,5}(?![0-9A-Za-z])){1,4})",
}
MENTION = "|".join(f"(?:{f})" for f in FORMS.values())


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if every second digit from the right, doubled and its digits added, makes a sum that ten divides."""
    at = lambda i: F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    places = F.sequence(F.lit(0), F.length(number) - 1)
    return F.aggregate(places, F.lit(0), lambda s, i: s + F.when(i % 2 == 0, at(i)).otherwise(twice(at(i)))) % 10 == 0


def passes(kind: Column, match: Column) -> Column:
    """Whether a match of a kind's base passes that kind's check."""
    own = digits(match)
    n = F.length(own)
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 4) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))
    card = F.when((n >= 16) & (n <= 19), luhn(own)).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", small).when(kind == "card", card).otherwise((n >= 8) & (n <= 15))


def _matches(text: str, form: str) -> tuple[Column, Column]:
    """A text's matches, and the pieces between them."""
    return F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)


def _starts(items: DataFrame, *by: str) -> DataFrame:
    """Adds where each match begins: what lies before it, pieces and matches, has been told as lengths."""
    before = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    long = F.length("_match").cast("bigint")
    return items.withColumn("_start", F.sum(F.col("_gap") + long).over(before) - long).withColumn("_end", F.col("_start") + long)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS else df


def read(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: a number, its key, the matches of every base and the mentions with the words around them."""
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    forms = BASES | {"mention": MENTION}
    needs = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+"))}
    for name, form in forms.items():
        found = _matches("_text", form)[0]
        rows = rows.withColumn(f"_m_{name}", F.when(needs[name], found).otherwise(F.array().cast("array<string>")) if name in needs else found)
    told: list[Column] = []
    for name, form in forms.items():
        pieces = F.when(F.size(f"_m_{name}") > 0, F.split("_text", form, -1))
        if name == "mention":
            side = F.transform(pieces, lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(AROUND)).alias("tail"), F.left(p, F.lit(AROUND)).alias("head")))
        else:
            side = F.transform(pieces, lambda p: F.length(p))
        told.append(side.alias(f"_p_{name}"))
    return rows.select("_row", "_key", *(f"_m_{name}" for name in forms), *told)


def base_spans(found: DataFrame) -> DataFrame:
    """(_row, _kind, _start, _end) of the bases that pass."""
    each = F.array(*(F.struct(F.lit(k).alias("_kind"), F.col(f"_m_{k}").alias("_m"), F.col(f"_p_{k}").alias("_p")) for k in KINDS))
    one = found.select("_row", F.explode(each).alias("_e")).where(F.size("_e._m") > 0).select("_row", "_e._kind", F.posexplode(F.arrays_zip(F.col("_e._m").alias("_match"), F.col("_e._p").alias("_gap"))).alias("_at", "_z"))
    one = one.select("_row", "_kind", "_at", "_z._match", F.col("_z._gap").cast("bigint").alias("_gap")).where("_match is not null")
    return _starts(one, "_row", "_kind").where(passes(F.col("_kind"), F.col("_match"))).select("_row", "_kind", "_start", "_end")


def mentions(found: DataFrame) -> DataFrame:
    """(_row, _kind, _match, _start, _end, _seed, _patterns): strings in a form of a kind, with the patterns around them."""
    zipped = F.arrays_zip(F.col("_m_mention").alias("_match"), F.col("_p_mention").alias("_piece"), F.slice("_p_mention", F.lit(2), F.greatest(F.size("_p_mention") - 1, F.lit(0))).alias("_next"))
    one = found.where(F.size("_m_mention") > 0).select("_row", F.posexplode(zipped).alias("_at", "_z")).select("_row", "_at", "_z._match", F.col("_z._piece.gap").cast("bigint").alias("_gap"), "_z._piece.tail", F.col("_z._next.head").alias("head"), F.col("_z._next.gap").alias("_rest")).where("_match is not null")
    one = _starts(one, "_row")
    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        kind = F.when(F.rlike("_match", F.lit(f"^(?:{FORMS[name]})$")), name).otherwise(kind)
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    # a word that the piece cuts is no word
    left = F.when(F.col("_gap") > AROUND, F.regexp_replace("tail", r"^\S*", "")).otherwise(F.col("tail"))
    right = F.when(F.col("_rest") > AROUND, F.regexp_replace("head", r"\S*$", "")).otherwise(F.col("head"))
    words = lambda c: F.filter(F.split(plain(c), r"\s+"), lambda w: w != "")
    one = one.withColumns({"_kind": kind, "_l": words(left), "_r": words(right)}).where("_kind is not null")
    last = lambda n: F.when(F.size("_l") >= n, F.concat(F.lit(f"{n}|"), F.array_join(F.slice("_l", -n, n), " ")))
    pair = F.when((F.size("_l") > 0) & (F.size("_r") > 0), F.concat(F.lit("lr|"), F.element_at("_l", -1), F.lit(" _ "), F.get("_r", F.lit(0))))
    whole = F.lit(False)
    for name in KINDS:
        whole |= (F.col("_kind") == name) & F.rlike("_match", F.lit(f"^(?:{BASES[name]})$")) & passes(F.lit(name), F.col("_match"))
    return one.select("_row", "_kind", "_match", "_start", "_end", whole.alias("_seed"), F.array_compact(F.array(last(1), last(2), last(3), pair)).alias("_patterns"))


def lower_end(share: Column, n: Column) -> Column:
    """The lower end of Wilson's interval of a share of n."""
    z = SIGMAS
    return (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def bootstrap(said: DataFrame, rounds: int = 3, least: float = 0.5) -> DataFrame:
    """(_kind, _match, _trust): unknown instances that confident patterns name. said: rows of `mentions`."""
    pairs = said.select("_kind", "_match", "_seed", F.explode("_patterns").alias("_pattern")).distinct()
    pairs = written(pairs, "pii-pairs")
    known = [F.count_if(F.col("_seed") & (F.col("_kind") == k)).alias(k) for k in KINDS]
    unknown = [F.count_if(~F.col("_seed") & (F.col("_kind") == k)).alias(f"no_{k}") for k in KINDS]
    counts = pairs.groupBy("_pattern").agg(F.count("*").alias("_n"), *known, *unknown)
    hope = [(F.col(k) > 0) & (F.col(f"no_{k}") > 0) & (lower_end((F.col(k) + F.col(f"no_{k}")) / F.col("_n"), F.col("_n")) >= least) for k in KINDS]
    likely = written(counts.where(hope[0] | hope[1] | hope[2] | hope[3]).select("_pattern", "_n"), "pii-patterns")
    edges = written(pairs.join(_few(likely), "_pattern"), "pii-edges")
    named = None
    for _ in range(rounds):
        trust = F.when(F.col("_seed"), 1.0)
        if named is None:
            scored = edges.withColumn("_t", trust.otherwise(0.0))
        else:
            scored = edges.join(_few(named), ["_kind", "_match"], "left").withColumn("_t", trust.otherwise(F.coalesce("_trust", F.lit(0.0))))
        share = F.col("_sum") / F.col("_n")
        patterns = scored.groupBy("_pattern", "_kind", "_n").agg(F.sum("_t").alias("_sum"), F.count_if("_seed").alias("_seeds"))
        patterns = patterns.withColumn("_trust", lower_end(share, F.col("_n"))).where((F.col("_trust") >= least) & (F.col("_seeds") > 0)).select("_pattern", "_kind", "_trust")
        patterns = written(patterns, "pii-confident")
        before, named = named, written(edges.where(~F.col("_seed")).join(_few(patterns), ["_pattern", "_kind"]).groupBy("_kind", "_match").agg(F.max("_trust").alias("_trust")), "pii-named")
        discard(patterns, *([before] if before is not None else []))
    discard(pairs, likely, edges)
    return named


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = 3, least: float = 0.5) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added for every row."""
    found = written(read(docs, key, text), "pii-found")
    said = written(mentions(found), "pii-mentions")
    base = base_spans(found)
    named = bootstrap(said, rounds, least)
    more = said.join(_few(named).withColumn("_named", F.lit(True)), ["_kind", "_match"], "left").where(F.col("_seed") | F.coalesce("_named", F.lit(False)))
    spans = base.withColumn("_base", F.lit(True)).unionByName(more.select("_row", "_kind", "_start", "_end", F.lit(False).alias("_base")))
    # both frames grow from their first row: one that shrinks is added up anew for every row
    sofar, own = (Window.unboundedPreceding, Window.currentRow), Window.partitionBy("_row")
    until = F.max(F.when(F.col("_base"), F.col("_end"))).over(own.orderBy("_start").rangeBetween(*sofar))
    since = F.min(F.when(F.col("_base"), F.col("_start"))).over(own.orderBy(F.desc("_start")).rangeBetween(*sofar))
    met = (F.coalesce(until, F.lit(-1)) > F.col("_start")) | (F.coalesce(since, F.col("_end")) < F.col("_end"))
    spans = spans.withColumn("_met", met).where(F.col("_base") | ~F.col("_met"))
    number = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        number = F.when(F.col("_kind") == k, i).otherwise(number)
    one = F.struct(number.alias("n"), F.col("_start").alias("a"), F.col("_end").alias("z"), F.col("_base").alias("b"))
    told = spans.groupBy("_row").agg(F.sort_array(F.collect_list(one)).alias("_s"))
    names = F.array(*(F.lit(k) for k in KINDS))
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat(F.get(names, x.n), F.lit(":"), x.a.cast("string"), F.lit(":"), x.z.cast("string"))), ",")
    rows = found.select("_row", "_key").join(told, "_row", "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<n:int,a:bigint,z:bigint,b:boolean>>")))
    of = lambda i: F.filter("_s", lambda x: x.b & (x.n == i))
    counts = [F.size(of(i)).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(F.col("_key").alias(key), *counts, F.sha2(line(F.filter("_s", lambda x: x.b)), 256).alias("base_sha256"), line(F.col("_s")).alias("spans"), F.size(F.filter("_s", lambda x: ~x.b)).cast("bigint").alias("n_added"))
