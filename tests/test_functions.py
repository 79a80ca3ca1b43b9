"""Column functions on golden values."""

import pytest
from pyspark.sql import functions as F

from concordat.functions import coerce, doi, rounding, sections, similarity, taxa, text, vocab
from concordat.operators import stability


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first().r


def many(spark, fn, values, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.r for r in rows.select("i", fn(F.col("x")).alias("r")).orderBy("i").collect()]


def test_doi(spark):
    raw = ["https://doi.org/10.1371/Test", "http://doi.org/10.1371/t", "DOI:10.1/x", " 10.1371/a b ", "", None]
    assert many(spark, doi.normalize, raw) == ["10.1371/test", "10.1371/t", "10.1/x", "10.1371/a b", "", ""]
    assert many(spark, doi.from_url, raw) == ["10.1371/Test", "10.1371/t", None, "10.1371/a b", None, None]
    variants = one(spark, doi.candidate_variants("x"), "10.1/a(b)%28+c")
    assert variants == ["10.1/a(b)%28+c", "https://doi.org/10.1/a(b)%28+c", "doi:10.1/a(b)%28+c", "10.1/a(b)(+c",
                        "10.1/a%28b%29%2528%2Bc"]
    assert one(spark, doi.candidate_variants("x"), "") == []
    pair = spark.createDataFrame([(None, None), ("doi:10.1/A", "10.1/a"), ("10.1/a", None)], "a string, b string")
    assert [r.r for r in pair.select(doi.same("a", "b").alias("r")).collect()] == [False, True, False]


def test_text(spark):
    cases = ["Straße  É x", "ﬁn ΣΑΣ", "  plain\tText ", None]
    assert many(spark, text.normalize_string, cases) == [
        None if c is None else " ".join(c.split()).casefold() for c in cases]
    assert one(spark, text.clean_markup("x"), "&lt;b&gt;T &amp;amp; &#233;&#xe9; <i>x</i> &nope;") == "T &amp; éé x &nope;"
    assert many(spark, text.ascii_key, ["Été, naïve ½!", "straße"]) == ["ete naive 12", "strae"]
    assert many(spark, text.normalize_path, ["a\\b.pdf", "nan", " "]) == ["a/b.pdf", None, None]


def test_vocabulary(spark):
    assert one(spark, vocab.data_type_list(F.col("x")), "EBV genetic analysis, presence only,Presence-absence records") == [
        "genetic_analysis", "presence-only", "presence-absence"]
    assert one(spark, vocab.geo_list(F.col("x")), "site coordinates maps, administrative unit x, maps") == [
        "site", "maps", "administrative_units", "x"]
    assert one(spark, vocab.species_list(F.col("x")), " a; b,, ") == ["a", "b"]
    assert one(spark, vocab.species_list(F.col("x")), " ; ") is None
    assert many(spark, lambda c: vocab.suggest_value(c, vocab.DATA_TYPES), ["presence only", "dens", "zzz"]) == [
        "Use 'presence-only'", "Consider 'density'",
        "Valid values: abundance, presence-absence, presence-only, density, distribution..."]


def test_coercion(spark):
    flags = ["yes", "No", " TRUE ", "0", "maybe", "", "NaN", None]
    assert many(spark, coerce.flag, flags) == [True, False, True, False, None, None, None, None]
    assert many(spark, coerce.year, ["1999.7", " 2001 ", "1e3", "x", "1999f"]) == [1999, 2001, 1000, None, None]
    assert many(spark, coerce.clean_cell, ["1,5", "1,234,567", "N/A", " a, b ", "not given"]) == [
        "1.5", "1.234.567", None, "a, b", None]
    assert many(spark, coerce.spatial_range, ["1 000,5", "1.234.567"]) == [1000.5, None]
    assert many(spark, coerce.atomic_list, ["['a', 'b']", "x", "[", None]) == [["a", "b"], ["x"], ["["], []]
    typed = spark.createDataFrame([(1, 1.0, True, "yes")], "a int, b double, c boolean, d string")
    truths = typed.select(*[coerce.is_true_label(F.col(c), k).alias(c) for c, k in typed.dtypes]).first()
    assert list(truths) == [False, False, True, True]  # a numeric one is not "true"


def test_taxa(spark):
    parsed = many(spark, taxa.parse_taxon, [
        "Tamias striatus", "caribou", "wood turtle (Glyptemys insculpta)", "Glyptemys insculpta (wood turtle)",
        "41 fish mock species", "beetles", "", "a (b)"])
    assert [(p.scientific, p.vernacular, p["count"], p.is_group_description) for p in parsed] == [
        ("Tamias striatus", None, None, False), (None, "caribou", None, False),
        ("Glyptemys insculpta", "wood turtle", None, False), ("Glyptemys insculpta", "wood turtle", None, False),
        (None, "fish", 41, True), (None, "beetles", None, True), (None, None, None, False), (None, "a (b)", None, False)]
    assert many(spark, taxa.normalize_group, ["weevil species", "species of benthic community", "ground-dwelling beetles",
                                              "flies", "grasses", "the virus", " species "]) == [
        "weevil", "benthic community", "ground-dwelling beetle", "fly", "grass", "virus", None]
    m = one(spark, taxa.parse_richness("x"), "c.132 species of benthic community")
    assert (m["count"], m.normalized_group, m.approximate) == (132, "benthic community", True)
    listed = ["73 weevil species", "c.32 ground-dwelling beetles, Acer saccharum"]
    assert one(spark, taxa.stripped_names("x"), listed, "x array<string>") == ["Acer saccharum"]
    assert one(spark, taxa.stripped_names("x"), ["Caribou; moose and wolves / bears, CARIBOU"], "x array<string>") == [
        "Caribou", "moose", "wolves", "bears"]
    mentions = taxa.richness_mentions("x")
    both = ["73 weevil species", "240 flying-beetles species"]
    assert one(spark, taxa.richness_group_keys(mentions), both, "x array<string>") == ["240|flying-beetle", "73|weevil"]
    assert one(spark, taxa.richness_counts("x", mentions), ["a b", "c d", " "], "x array<string>") == [2]


def test_similarity(spark):
    pairs = [("tamias striatus", "tamias striata", 89.6551724), ("", "", 100.0), ("a", "", 0.0),
             ("wood turtle (glyptemys insculpta)", "glyptemys insculpta", 73.0769231)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in df.select("want", similarity.indel_ratio("a", "b").alias("u"), similarity.indel_ratio_sql("a", "b").alias("q")).collect():
        assert r.u == pytest.approx(r.want) and r.q == pytest.approx(r.want)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_lcs_against_table():
    import random

    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(2))
        assert similarity.lcs_length(a, b) == _lcs(a, b)


def test_pruning_does_not_change_matches():
    import random

    rng = random.Random(5)

    def naive(truths, preds, threshold):
        def ratio(a, b):
            return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0

        def score(t, p):
            if t[0] == p[0]:
                return True, 100.0
            best = ratio(t[0], p[0])
            if best >= threshold:
                return True, best
            for x in t[1:]:
                for y in p[1:]:
                    s = ratio(x, y)
                    best = max(best, s)
                    if s >= threshold:
                        return True, s
            if t[0] in p[0]:
                return True, 95
            if any(x in p[0] for x in t[1:]):
                return True, 90
            return best >= threshold, best
        out = []
        for p in preds:
            top, name = 0, None
            for t in truths:
                hit, s = score(t, p)
                if s > top:
                    top = s
                    if hit:
                        name = t[0]
            out.append(name or p[0])
        return out

    def name():
        full = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9)))
        return [full, *[full[: rng.randrange(len(full) + 1)] or "q" for _ in range(rng.randrange(1, 3))]]

    for threshold in (50, 70, 90, 95, 98):
        for _ in range(60):
            truths, preds = ([name() for _ in range(rng.randrange(5))] for _ in range(2))
            assert similarity._canonical_predictions(truths, preds, threshold) == naive(truths, preds, threshold)


def test_headings_and_sentences(spark):
    heads = ["1. Introduction", "2.3 Materials and Methods", "IV. Results", "Résumé", "Mix design", "(a) Study area",
             "Data Availability Statement", "Acknowledgements", "Some Novel Section", ""]
    assert many(spark, sections.section_type, heads) == [
        "INTRO", "METHODS", "RESULTS", "ABSTRACT", "OTHER", "METHODS", "DATA_AVAILABILITY", "ACK", "OTHER", "OTHER"]
    t = "Hello et al. World. See e.g. a@b.  Fig. 3!\nEnd"
    assert one(spark, sections.sentences("x"), t) == ["Hello et al. World.", "See e.g. a@b.", "Fig. 3!", "End"]
    assert one(spark, sections.sentences("x", literal_at_sign=True), t)[1] == "See e.g. a.b."
    f = one(spark, sections.content_flags("x"), "Cost $5 and $6. See Fig 2\n[1] Ref")
    assert tuple(f) == (True, False, True, True)


def test_rounding_matches_python(spark):
    values = [k / 20000 for k in range(1, 400)] + [0.00125, 2.675, 1e-9, 123456.78905, -0.00015]
    got = many(spark, lambda c: rounding.round_exact(c, 4), values, "x double")
    assert got == [round(v, 4) for v in values]


def test_ks_p_values(spark):
    # Checked against the exact two-sided distribution: P(D <= d) for n = 1 is 2d - 1 (d >= 1/2).
    for d in (0.5, 0.6, 0.75, 0.9):
        assert stability._exact_p(1, d) == pytest.approx(1 - (2 * d - 1), abs=1e-12)
    # n = 10, d = 0.409 is the tabulated 5 % point.
    assert stability._exact_p(10, 0.40925) == pytest.approx(0.05, abs=2e-4)
    rows = spark.createDataFrame([(1000, 0.0427), (10, 0.40925), (5, 0.0), (5, 1.0), (None, 0.5)], "n int, d double")
    got = [r.p for r in rows.select(stability.ks_p_value(F.col("n"), F.col("d")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=2e-3) and got[1] == pytest.approx(0.05, abs=5e-3) and got[2:] == [1.0, 0.0, None]
    exact = rows.limit(2).select(stability.ks_p_value(F.col("n"), F.col("d"), "exact").alias("p")).collect()
    assert exact[1].p == pytest.approx(0.05, abs=2e-4)


def test_html_references_follow_the_standard(spark):
    import html

    cases = [f"a &{n} z" for n in html.entities.html5] + [f"&{n}x=1" for n in html.entities.html5]
    cases += [f"&#{k};" for k in range(300)] + [f"&#x{k:x}" for k in range(300)]
    cases += ["&#55296;", "&#1114112;", "&#99999999999999;", "&amp;lt;", "&amp c", "&;", "&#;", "& b", "&&amp;", "x&notit;y", "&#xFFFE;"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c string")
    got = {r.i: r.x for r in df.select("i", text.unescape_html("c").alias("x")).collect()}
    assert [c for i, c in enumerate(cases) if got[i] != html.unescape(c)] == []


def test_ascii_key_folds_every_code_point(spark):
    import re
    import unicodedata

    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"k{chr(c)}m") for c in points], "i int, c string").repartition(4)
    got = {r.i: r.x for r in df.select("i", text.ascii_key("c", cleaned=True).alias("x")).collect()}
    plain = lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower()
    assert [hex(c) for c in points if got[c] != re.sub("[^a-z0-9]+", " ", plain(f"k{chr(c)}m")).strip()] == []
