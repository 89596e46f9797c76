import datetime

import pytest
from pyspark.sql import functions as F

from signalrank.functions import dates, predicates, text

D = datetime.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [
    ("NBER Working Paper No. 31705: Inflation and Wages", "inflation and wages"), ("Régional Growth, Ørsted & Søn", "regional growth orsted son"), ("Working Paper 12 — Straße", "strasse"),
    ("", ""), (None, ""), ("IMF: CEPR", ""), ("  A   B ", "a b"), ("Discussion Paper No. 7 Land Use", "land use"), ("Łódź þing Æon", "lodz thing aeon"),
])
def test_titles(spark, raw, want):
    assert one(spark, text.normalize_title(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,name,last", [
    ("O'Brien, Sean Jr.", "obrien sean", "obrien"), ("John Maynard Keynes", "john maynard keynes", "keynes"), ("Jean-Luc Picard PhD", "jean-luc picard", "picard"), ("Plato", "plato", "plato"),
    ("", "", ""), ("Müller, Änne", "muller anne", "muller"), ("- -", "", ""), (",", "", ""),
])
def test_names(spark, raw, name, last):
    assert one(spark, text.normalize_name(F.lit(raw))) == name and one(spark, text.last_name(F.lit(raw))) == last


def test_identifiers(spark):
    names = F.array(F.lit("Zhao, Alice"), F.lit("John Smith"), F.lit(""))
    assert one(spark, text.last_names(names)) == ["smith", "zhao"]
    import hashlib

    assert one(spark, text.canonical_id(F.lit("A Theory of Wages"), names)) == hashlib.sha256(b"a theory of wages|smith,zhao").hexdigest()[:16]
    for raw in ("10.3386/W31705", "https://doi.org/10.3386/w31705", "http://dx.doi.org/10.3386/w31705", "doi:10.3386/w31705", " doi.org/10.3386/w31705 "):
        assert one(spark, text.normalize_doi(F.lit(raw))) == "10.3386/w31705"
    assert one(spark, text.normalize_doi(F.lit(""))) is None
    assert one(spark, text.doi_in_text(F.lit("see https://doi.org/10.1257/aer.2020.1). And 10.1111/x"))) == "10.1257/aer.2020.1"
    assert one(spark, text.doi_in_text(F.lit("no such 10.1/x thing"))) is None
    for raw, doi in {"at doi.org/10.1257/aer.1": None, "(10.1257/abcd.e)": "10.1257/abcd.e", "10.1257/abc is short": None, "doi:10.1257/a": "10.1257/a", "x10.1257/abcd": None, "é10.1257/abcd": None, "v.10.1257/abcd": "10.1257/abcd"}.items():
        assert one(spark, text.doi_in_text(F.lit(raw))) == doi, raw
    assert one(spark, text.nber_doi(F.lit("https://www.nber.org/papers/W123 new"))) == "10.3386/w123"
    assert one(spark, text.arxiv_id(F.lit("http://arxiv.org/abs/2401.01234v2"))) == "2401.01234v2" and one(spark, text.strip_version(F.lit("2401.01234v2"))) == "2401.01234"
    assert one(spark, text.repec_handle(F.lit("https://x.org/r?u=RePEc%3Aabc%3Adef"))) == "RePEc:abc:def"


def test_sets(spark):
    a, b, none = F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b"), F.lit("c"), F.lit("d")), F.array().cast("array<string>")
    assert one(spark, text.jaccard(a, b)) == 0.5 and one(spark, text.jaccard(a, a)) == 1.0 and one(spark, text.jaccard(none, none)) == 0.0 and one(spark, text.jaccard(a, none)) == 0.0
    assert one(spark, text.shared_last_names(F.array(F.lit("John Smith")), F.array(F.lit("Jane Smith"), F.lit("Bob Jones")))) == 1


def test_text_helpers(spark):
    assert one(spark, text.strip_html_inline(F.lit("<p>a<b>b</b></p><p>c<br/>d</p><script>x</script>&amp;"))) == "ab c d &"
    assert one(spark, text.strip_html(F.lit("<td>a</td><td>b&nbsp;c</td>"))) == "a b c"
    assert one(spark, text.strip_markup(F.lit("<jats:p>Hello <jats:italic>world</jats:italic>.</jats:p>"))) == "Hello world ."
    assert one(spark, text.snippet(F.lit("abc  def ghi"), 8)) == "abc def…" and one(spark, text.snippet(F.lit(None).cast("string"), 5)) == ""
    index = F.from_json(F.lit('{"wages":[1],"and":[0,2],"prices":[3]}'), "map<string,array<int>>")
    assert one(spark, text.from_inverted(index)) == "and wages and prices"
    assert one(spark, text.split_byline(F.lit("A Title -- by Ann B, C. D and E F")))["authors"] == ["Ann B", "C. D", "E F"]
    assert one(spark, text.split_byline(F.lit("No byline")))["authors"] == []
    assert one(spark, text.jel_codes(F.lit("Text. JEL codes: O12, R31; J1. More A1"))) == ["O12", "R31", "J1"]
    assert one(spark, text.author_line(F.array(*[F.lit(x) for x in "abcd"]))) == "a, b, c +1"
    assert one(spark, text.score_bar(F.lit(0.25))) == "##--------" and one(spark, text.score_bar(F.lit(0.35))) == "####------"
    assert one(spark, text.handle_label(F.lit("@@x"))) == "@x" and one(spark, text.type_label(F.lit("journal_article"))) == "Journal Article"
    assert one(spark, text.cache_key(F.lit(""), F.lit(None), F.lit("T"))).startswith("title:") and one(spark, text.cache_key(F.lit("doi:10.1/X"), F.lit(1), F.lit("T"))) == "doi:10.1/x"
    assert one(spark, text.decode_twice(F.lit("a &amp;amp; b"))) == "a & b" and one(spark, text.decode_entities_exact(F.lit("&amp;eacute;"))) == "é"
    assert one(spark, text.strip_accents_exact(F.lit("Ørsted Ҩé"))) == "Orsted e"
    assert one(spark, text.absolute_link(F.lit("/cfp"), F.lit("https://c.org/a/b"))) == "https://c.org/cfp" and one(spark, text.absolute_link(F.lit("x"), F.lit("https://c.org/a/b"))) == "https://c.org/a/x"
    assert one(spark, text.library_tokens(F.lit("The Wages-of x war 12"), ["the"])) == ["wages-of", "war"]
    assert one(spark, text.window_around(F.lit("abc Call for Papers now"), "(?i)call for papers", 4, 8)) == "abc Call for"


@pytest.mark.parametrize("days,want", [(60, 60), (28, 30), (10, 14), (5, 7), (2, 3), (0, 1), (90, None), (-1, None)])
def test_thresholds(spark, days, want):
    assert one(spark, dates.alert_threshold(F.lit(days))) == want


@pytest.mark.parametrize("raw,want", [("2024-03-15", 1.0), ("2024-03-15T10:00:00Z", 1.0), (None, 0.5), ("junk", 0.5), ("2030-01-01", 0.5), ("2023-01", 0.0), ("2024-02-01", 1 - (46 - 7) / 83)])
def test_recency(spark, raw, want):
    assert abs(one(spark, dates.recency(F.lit(raw).cast("string"), F.lit("2024-03-18").cast("date"))) - want) < 1e-9


def test_dates(spark):
    day = lambda x: F.lit(x).cast("date")
    assert one(spark, dates.parse_long(F.lit("March 3rd, 2025"))) == D(2025, 3, 3) and one(spark, dates.parse_long(F.lit("3 Sept 2025"))) in (D(2025, 9, 3), None)
    assert one(spark, dates.parse_slash(F.lit("01/31/2026"))) == D(2026, 1, 31) and one(spark, dates.parse_slash(F.lit(""))) is None
    assert one(spark, dates.from_parts(F.array(F.array(F.lit(2024), F.lit(5))))) == D(2024, 5, 1) and one(spark, dates.from_parts(F.array().cast("array<array<int>>"))) is None
    assert one(spark, dates.next_fifteenth(F.lit(3), day("2026-03-16"))) == D(2027, 3, 15) and one(spark, dates.next_fifteenth(F.lit(3), day("2026-03-15"))) == D(2026, 3, 15)
    curated = lambda *a: one(spark, dates.curated_dates(*[F.lit(x) for x in a[:4]], day("2026-05-01")))
    assert curated("2026-09-01", 1, None, "annual") == [D(2026, 9, 1)] and curated("2025-01-01", 2, 8, "biannual") == [D(2026, 8, 15), D(2027, 2, 15)] and curated(None, None, None, "rolling") == []
    found = one(spark, dates.deadline_dates(F.lit("Apply. The deadline is March 3, 2026 or 15 May 2026. Founded January 1, 1990."), ["deadline"]))
    assert found == [D(2026, 3, 3), D(2026, 5, 15)]
    assert one(spark, dates.season_or_month(F.lit("Spring 2021"))) == D(2021, 4, 1) and one(spark, dates.season_or_month(F.lit("(Nov. 2020)"))) == D(2020, 11, 1) and one(spark, dates.season_or_month(F.lit("x"))) is None
    assert one(spark, dates.urgency(F.lit(3))) == "final" and one(spark, dates.urgency(F.lit(46))) == "upcoming" and one(spark, dates.urgency(F.lit(None).cast("int"))) == "rolling"
    assert one(spark, dates.parse_mail_date(F.lit("Tue, 05 Mar 2024 10:00:00 GMT"))).day == 5
    assert one(spark, dates.year_start(F.lit(2020))) == D(2020, 1, 1) and one(spark, dates.year_start(F.lit(99))) is None
    published = dates.published_on(day(None), day("2024-01-05"), [day("2023-01-01")], day("2024-02-01"))
    assert one(spark, published) == D(2023, 1, 1)


def test_predicates(spark):
    yes = lambda c: one(spark, c)
    assert yes(predicates.is_caption(F.lit("The image shows"))) and not yes(predicates.is_caption(F.lit("Imagery"))) and not yes(predicates.is_caption(F.lit(None).cast("string")))
    post = lambda content, handle=None, paper=None: yes(predicates.is_econ_post(F.lit(content), F.lit(handle).cast("string"), F.lit(paper).cast("long"), ["econ.example"], ["known"], ["land use"]))
    assert post("x", paper=1) and post("10.1257/aer.1") and post("x", "@a@econ.example") and post("x", "@known@else") and post("New Land Use paper") and not post("island user") and not post("The chart shows land use", paper=1)
    assert yes(predicates.is_blocked_link(F.lit("https://sub.zenodo.org/1"))) and not yes(predicates.is_blocked_link(F.lit("https://notzenodo.org/1"))) and yes(predicates.is_blocked_doi(F.lit("https://doi.org/10.5281/z")))
    assert yes(predicates.names_india(F.lit("in Indiana"))) and not yes(predicates.names_india(F.lit("in France"))) and yes(predicates.is_editorial(F.lit(" Front Matter "))) and not yes(predicates.is_editorial(F.lit("Matter")))
    clean = lambda name, due, curated: yes(predicates.is_clean_deadline(F.lit(name), F.lit(due).cast("date"), F.lit(curated)))
    assert clean("Grant", "2026-01-01", False) and clean("Grant", None, True) and not clean("Grant", None, False) and not clean("The image of", "2026-01-01", True)


def test_folding_agrees_with_unicode(spark):
    """Every character that decomposes, alone and in a text, against the exact form."""
    import unicodedata

    chars = [chr(k) for k in range(0x80, 0x1F300) if unicodedata.decomposition(chr(k)) and not 0xD800 <= k < 0xE000]
    rows = [(c,) for c in chars] + [("Nguyễn Thị Ế",), ("ﬁscal policy",), ("Ａｂｃ … ½ ™ № straße Øre",), ("plain",), (None,), ("",), ("日本語 text",)]
    found = spark.createDataFrame(rows, "t string").select("t", text.strip_accents(F.col("t")).alias("a"), text.strip_accents_exact(F.col("t")).alias("b")).collect()
    assert [r for r in found if r["a"] != r["b"]] == []
    assert one(spark, text.normalize_title(F.lit("Nguyễn Thị Ế: ﬁscal policy"))) == "nguyen thi e fiscal policy"
    assert one(spark, text.normalize_name(F.lit("Nguyễn Thị Ế"))) == "nguyen thi e"


def test_series_go_until_none_is_left(spark):
    nested = "a title"
    for k in range(6):
        nested = f"working {nested} paper" if k == 0 else f"working working paper paper {nested}"
    deep = "w" * 0 + "working " * 5 + "paper " * 5 + "on trade"
    assert one(spark, text.normalize_title(F.lit(deep))) == "on trade"
    assert "working paper" not in one(spark, text.normalize_title(F.lit(nested)))
    assert one(spark, text.normalize_title(F.lit("nnbernbernber w paper"))) == "nnbernbernber w paper"
