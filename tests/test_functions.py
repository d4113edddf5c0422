import math
from hashlib import blake2b

from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.functions import vectors as V
from docquarry.operators import curation as C


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_normal_forms(spark):
    df = spark.createDataFrame([("  A Study—of\nPaper Agents! ",), (None,), ("!!",), ("Straße",)], "t string")
    got = [r[0] for r in df.select(X.normalize_title("t")).collect()]
    assert got == ["a study of paper agents", None, None, "strasse"]


def test_identifiers(spark):
    r = one(spark, X.extract_doi(F.lit("https://doi.org/10.1234/ABC.5")), X.extract_arxiv_id(F.lit("arXiv:2401.01234v2")), X.extract_year(F.lit("in 2019, 2020")), X.extract_doi(F.lit("none")))
    assert tuple(r) == ("10.1234/abc.5", "2401.01234", 2019, None)


def test_edge_clean_text(spark):
    text = "Conference 2026\nFirst page content\n1\fConference 2026\nSecond page content\n2"
    r = one(spark, X.edge_clean_text(F.lit(text)), X.content_fingerprint(F.lit("   \n\f  ")))
    assert r[0] == "first page content\nsecond page content" and r[1] is None


def test_rewrites_keep_the_question_first(spark):
    r = one(spark, X.rewrites(F.lit("How is  the codebook, built?")), X.citations(F.lit("a [E12] b [P7] c [E12]")))
    assert r[0] == ["How is the codebook, built?", "How is the codebook, built", "How is the codebook built"] and r[1] == ["E12", "P7"]


def test_authors_and_titles(spark):
    r = one(spark, X.split_authors(F.lit("Alice Smith; Bob Li and X, Carl de Vries")), X.venue_title(F.lit("CVPR-2024-Deep_Things.pdf")), X.normalize_authors(F.array(F.lit("A. Smith"), F.lit("!"))))
    assert r[0] == ["Alice Smith", "Bob Li", "Carl de Vries"] and r[1] == "Deep Things" and r[2] == ["a smith"]


def test_entailment(spark):
    e = lambda s, *t: V.entailment(F.lit(s), F.array(*map(F.lit, t)))
    r = one(spark, e("we use data", "So we use data here."), e("we do not use data", "we do use data"), e("we use data", "unrelated words"), e("...", "x"))
    assert tuple(r) == ("supported", "contradicted", "insufficient", "insufficient")


def test_hashed_vectors_against_plain_python(spark):
    def plain(words, n):
        v = [0.0] * n
        feats = words + [a + "␟" + b for a, b in zip(words, words[1:])]
        for f in set(feats):
            d = blake2b(f.encode(), digest_size=16).digest()
            v[int.from_bytes(d[:8], "big") % n] += (1 if d[8] & 1 else -1) * math.log1p(feats.count(f))
        s = math.sqrt(sum(x * x for x in v))
        return [x / s for x in v] if s else v

    df = spark.createDataFrame([("Build a codebook a b",), ("",)], "t string")
    got = [r[0] for r in df.select(V.hashing_embedding()("t")).collect()]
    assert all(abs(x - y) < 1e-12 for x, y in zip(got[0], plain("build a codebook a b".split(), 256))) and not any(got[1])


def test_similar_titles_finds_all_pairs(spark):
    from difflib import SequenceMatcher

    base = "a fairly long title about grounding moments in videos"
    titles = [base, base.replace("fairly", "faily"), base + "s", "another long title that shares nothing at all with it", base.replace("moments", "moment"), "xy" * 12]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    got = {(r["a"], r["b"]) for r in C.similar_titles(df, "id", "t").collect()}
    want = {(i, j) for i, x in enumerate(titles) for j, y in enumerate(titles) if i < j and max(SequenceMatcher(None, x, y).ratio(), min(len(x), len(y)) / max(len(x), len(y)) if x in y or y in x else 0) >= 0.94}
    assert got == want


def test_venues_and_years(spark):
    r = one(spark, C.infer_venue(F.lit("CVPR2024_x.pdf"), F.lit("")), C.infer_venue(F.lit("x.pdf"), F.lit("Proceedings of ICML")), C.infer_year(F.lit("x 2021.pdf"), F.lit("")), C.infer_year(F.lit("AAAI-23.pdf"), F.lit("")), C.primary_paradigm(C.paradigm_tags(F.lit("A zero-shot LLM"))))
    assert r[0]["source"] in ("filename", "unknown") and r[1]["venue"] == "ICML" and (r[2], r[3], r[4]) == (2021, 2023, "llm_based")
