"""The literal cases of the admissions domain."""

import pytest
from pyspark.sql import functions as F

from admitflow.functions import pages as P
from admitflow.functions import text as T
from admitflow.operators import rules as G
from admitflow.plans import recommend as K


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("v")).first().v


@pytest.mark.parametrize(("raw", "low", "high"), [("2", 2, 2), ("3 4", 3, 4), ("1.15", 1.15, 1.15), ("4 to 3", 3, 4), ("", None, None), ("1 2 3", None, None), (None, None, None)])
def test_duration(spark, raw, low, high):
    got = one(spark, raw, T.parse_duration)
    assert (got["min"], got["max"]) == (low, high) and (got.error is None) == (low is not None)


@pytest.mark.parametrize(("raw", "months"), [("Mar/July", ["MAR", "JUL"]), ("Jan/Mar/Jul/Oct", ["JAN", "MAR", "JUL", "OCT"]), ("Oct, jan,JAN", ["JAN", "OCT"]), ("May", None), ("", None)])
def test_intakes(spark, raw, months):
    assert one(spark, raw, T.parse_intakes).months == months


def test_scores(spark):
    assert tuple(one(spark, "6.5 (6.0)", T.parse_score_text)) == (6.5, 6.0, 6.0, 6.0, 6.0, 6.0, None)
    assert tuple(one(spark, "7.5 (7.0 R/W; 8.0 L/S)", T.parse_score_text)) == (7.5, 7.0, 8.0, 7.0, 8.0, 7.0, None)
    assert tuple(one(spark, "6.0 (see 5.5)", T.parse_score_text))[:2] == (6.0, 5.5)
    assert tuple(one(spark, "", T.parse_score_text)) == (None,) * 7
    assert tuple(one(spark, "7.0", T.parse_score_text)) == (7.0, *(None,) * 6)


def test_tests_and_details(spark):
    found = one(spark, "IELTS Academic overall 6.5 with no band below 6.0. PTE Academic 61.", T.language_tests)
    assert [tuple(t) for t in found] == [("IELTS Academic", "6.5", "6.0"), ("PTE Academic", "61", None)]
    details = one(spark, "Applications are made directly to the University. Limited places apply. Please submit a portfolio, CV and supplementary form.", T.application_details)
    assert details.limited_places and details.requires_portfolio and "CV" in details.required_documents and details.selection_notes[0].startswith("Limited places")
    details = one(spark, "Please provide a statement of intent with your form", T.application_details)
    assert details.requires_personal_statement and details.required_documents == ["Personal statement"]


def test_pathways(spark):
    text = "Admission requirements: a bachelor's degree in business with a credit average or a bachelor's degree in another discipline with a pass average and 1 year relevant work experience."
    found = one(spark, text, T.academic_pathways)
    assert len(found) >= 2 and found[0].qualification == "bachelor's degree" and found[1].work_experience == "1 year relevant work experience"


def test_small_text(spark):
    assert one(spark, " A&amp;B - <b>x</b><br/>y</p>z :", T.strip_html) == "A&B - x y z"
    assert one(spark, "https://a.b/c;p?q=1#f", T.canonical_url) == "https://a.b/c"
    assert [one(spark, x, T.canonical_number) for x in ("2.0", "6.50", "10", "x", "10.00")] == ["2", "6.5", "10", "x", "10"]
    assert one(spark, "Juris Doctor of Law", T.degree_type) == "Doctor" and one(spark, "Bachelor", T.degree_type) is None
    long = one(spark, "word " * 100, lambda c: T.trimmed(c, 240))
    assert long.endswith("...") and len(long) <= 242
    assert one(spark, "a" * 200 + " needle " + "b" * 300, lambda c: T.snippet(c, F.array(F.lit("NEEDLE")))).index("needle") == 80
    assert one(spark, "The Art & Design (the) School", T.match_key) == "art and design school"
    assert one(spark, "x", lambda c: T.dedupe_folded(F.array(F.lit("Cv"), F.lit("CV"), F.lit("b")), 2)) == ["Cv", "b"]
    assert one(spark, "short|a bachelor degree. English requirements: x|For academic requirements check the page of the bachelor degree", lambda c: P.best_text(F.split(c, r"\|"))) == "a bachelor degree."
    assert one(spark, "abc|xyz", lambda c: P.best_text(F.split(c, r"\|"))) == "abc"


@pytest.mark.parametrize(
    ("background", "course", "mark"),
    [("211", "", 75), ("双非", "", 80), ("985", "Master of Computer Science", 75), ("其他国内院校", "Master of Computer Science", 80), ("C9", "Master of Commerce", 65), ("211", "Master of Professional Accounting", 75), ("双非", "Master of Commerce", 87), ("非211", "x", 80), ("Tier-1", "Master of Commerce", 65)],
)
def test_minimum_average(spark, background, course, mark):
    assert one(spark, background, lambda c: G.minimum_average(G.background_category(c), F.lit(any(x in course.lower() for x in G.BUSINESS_CORE)))) == mark


def test_expand(spark):
    got = one(spark, "计算机", K.expand)
    assert {"computer science", "information technology"} <= set(got.keywords) and "software engineering" in got.semantic_query
    assert "data analytics" in one(spark, "数据分析", K.expand).keywords and "finance" in one(spark, "商科", K.expand).keywords
    assert one(spark, "  Fine   arts ", K.expand).keywords == ["Fine arts"]
    assert one(spark, "S1, semester 2;Feb", lambda c: K.wanted_intakes(F.replace(c, F.lit(";"), F.lit(",")))) == ["FEB", "JUL"]


def test_bands(spark):
    assert [one(spark, str(s), lambda c: K.band_of(c.cast("double"))) for s in (0.949, 0.95, 1.1, 1.101)] == ["REACH", "MATCH", "MATCH", "SAFETY"]


BASE = {
    "keywords": ["computer science"], "gpa": 82.0, "overall": 7.0, "min_band": 6.5, "user_listening": 6.5, "user_reading": 6.5, "user_speaking": 6.5, "user_writing": 6.5, "background": "双非",
    "subjects_text": "Computer Science, Programming, Statistics", "want_intakes": ["FEB"], "budget_min": 0.0, "budget_max": 70000.0, "want_min": 1.0, "want_max": 2.0, "want_degree": "", "want_campus": "",
    "accepts_pathway": False, "course_name": "Master of Computer Science", "academic_text": "A bachelor's degree in a related discipline.", "reason": "Keyword matched", "need_overall": 6.5, "need_band": 6.0,
    "listening": 6.0, "reading": 6.0, "speaking": 6.0, "writing": 6.0, "intakes": ["FEB"], "fee": 56000.0, "duration_min": 1.5, "duration_max": 1.5, "degree": "Master", "campus": "", "relevance": 0.6, "target": "计算机", "english_text": "6.5 (6.0)", "want_faculty": "", "want_school": "", "want_mode": "", "faculty": "", "school": "", "study_mode": "",
}
SCHEMA = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'string'}" for k, v in BASE.items())


@pytest.mark.parametrize(
    ("change", "status", "missing"),
    [
        ({}, "ELIGIBLE", None),
        ({"gpa": 70.0}, "INELIGIBLE", None),
        ({"gpa": 70.0, "accepts_pathway": True, "academic_text": "A graduate certificate pathway is offered."}, "PATHWAY_REQUIRED", None),
        ({"overall": 6.0}, "INELIGIBLE", None),
        ({"writing": 7.0}, "INELIGIBLE", None),
        ({"overall": None, "min_band": None}, "UNKNOWN", "user_ielts"),
        ({"want_intakes": ["JUL"]}, "INELIGIBLE", None),
        ({"subjects_text": "History", "academic_text": "prerequisite mathematics"}, "HIGH_RISK", None),
        ({"fee": 90000.0}, "HIGH_RISK", None),
        ({"duration_min": 3.0, "duration_max": 3.0}, "INELIGIBLE", None),
        ({"need_overall": None}, "UNKNOWN", "ielts_requirement"),
        ({"gpa": None}, "UNKNOWN", "user_gpa"),
        ({"want_degree": "phd"}, "INELIGIBLE", None),
        ({"want_campus": "city"}, "UNKNOWN", "campus"),
        ({"want_campus": "city, north", "campus": "North campus"}, "ELIGIBLE", None),
        ({"want_faculty": "law", "faculty": "Faculty of Arts"}, "INELIGIBLE", None),
        ({"want_school": "law"}, "UNKNOWN", "school"),
        ({"want_mode": "online", "study_mode": "Online, part time"}, "ELIGIBLE", None),
        ({"want_mode": "online", "study_mode": "On campus"}, "INELIGIBLE", None),
    ],
)
def test_gate(spark, change, status, missing):
    row = spark.createDataFrame([tuple((BASE | change).values())], SCHEMA)
    got = K.judged(row).select("status", G.missing_fields(F.col("checks")).alias("missing"), "score", "exclusion").first()
    assert got.status == status
    assert missing is None or missing in got.missing


def test_scores_and_exclusions(spark):
    row = lambda **change: K.judged(spark.createDataFrame([tuple((BASE | change).values())], SCHEMA)).first()
    assert row().score == pytest.approx(0.7 * 82 / 80 + 0.3 * 7 / 6.5)
    assert row(min_band=5.5, need_band=7.0).exclusion == "ielts_band_below_requirement"
    assert row(relevance=0.01).exclusion == "low_relevance"
    assert row(need_overall=None).exclusion == "scoring_failed"
    assert row(fee=90000.0).exclusion == "tuition_outside_budget"


@pytest.mark.parametrize(
    ("change", "kind", "text"),
    [
        ({"gpa": 70.0}, "blocking_reasons", "GPA is below"),
        ({"overall": 6.0}, "blocking_reasons", "IELTS is below: overall 6 < 6.5"),
        ({"writing": 7.0}, "blocking_reasons", "writing 6.5 < 7"),
        ({"want_intakes": ["JUL"]}, "blocking_reasons", "intake"),
        ({"subjects_text": "History", "academic_text": "prerequisite mathematics"}, "warnings", "prerequisite can't be confirmed for: mathematics"),
        ({"gpa": 70.0, "accepts_pathway": True, "academic_text": "Other. A graduate certificate pathway is offered. End."}, "warnings", "A graduate certificate pathway is offered."),
    ],
)
def test_reasons(spark, change, kind, text):
    row = spark.createDataFrame([(1, 2, *(BASE | change).values())], f"applicant_id int, course_id int, {SCHEMA}")
    got = K.decisions(K.judged(row)).first()
    assert any(text in r for r in got[kind]) and len(got.checks) == 14 and got.summary
    rows = G.checklist(K.judged(row), "course_id").collect()
    assert [r.place for r in rows] == list(range(1, 15)) and all(r.reason for r in rows) and rows[0].evidence_text


def test_deadline_and_programs(spark):
    assert one(spark, "First. Applications close on 5 May for all. Then", G.deadline_text) == "Applications close on 5 May for all"
    assert one(spark, "Nothing", G.deadline_text) == ""
    row = spark.createDataFrame([(1, 2, 1, [], *BASE.values())], f"applicant_id int, course_id int, rank int, evidence array<struct<text:string,source_url:string,source:string>>, {SCHEMA}")
    got = K.program_rows(K.judged(row)).first()
    assert got.duration == "1.5 years" and got.ielts_requirement == "IELTS 6.5 overall, minimum band 6" and got.evidence[0].source == "requirement_summary"
    assert got.recommendation_reason.startswith("GPA: user 82 vs required 80. IELTS: user 7/6.5 vs required 6.5/6. Relevance: Keyword matched. Evidence: A bachelor's degree")


def test_application_text(spark):
    details = one(spark, "Limited places apply. Please submit a portfolio and CV.", T.application_details)
    assert details.limited_places
    text = one(spark, "Limited places apply. Please submit a portfolio and CV.", lambda c: P.application_index_text(c, T.application_details(c)))
    assert "Required documents: Portfolio; CV" in text and "Portfolio required" in text and "Limited places" in text and "Selection notes: Limited places apply." in text


def test_structured_requirements(spark):
    core = '{"attributes":{"entryRequirements":{"entryRequirementsByYear":[{"entryRequirements":[{"codeDesc":"IELTS","description":"A minimum result of 6.5 overall and a minimum result of 6.0 in each band"},{"codeDesc":"TOEFL","description":"85: 17, 18"},{"codeDesc":"Other","description":"1"}]},{"entryRequirements":[]}]}}}'
    tests = one(spark, core, lambda c: P.structured_tests(F.from_json(c, P.COREDATA)))
    assert [(t.test_name, t.overall, t.component_scores) for t in tests] == [
        ("IELTS Academic", "6.5", {"listening": "6.0", "reading": "6.0", "speaking": "6.0", "writing": "6.0"}),
        ("TOEFL iBT", "85", {"reading": "17", "listening": "18"}),
    ]
    for none in (None, "{}", '{"attributes":{"entryRequirements":{"entryRequirementsByYear":[]}}}'):
        assert one(spark, none, lambda c: P.structured_tests(F.from_json(c, P.COREDATA))) == []


def test_all_character_references(spark):
    """As the standard library decodes them: every name with and without its semicolon, odd numbers, and what is no reference."""
    import html
    from html.entities import html5

    odd = [0, 1, 8, 9, 11, 13, 31, 65, 127, 128, 129, 153, 159, 160, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x10FFFE, 0x10FFFF, 0x110000, 10**12]
    texts = [f"a &{n} b&{n.rstrip(';')}x" for n in html5] + [f"&#{n};&#{n}z&#x{n:x};&#X{n:X} &#00{n};" for n in odd]
    texts += ["", "&", "&&", "&;", "&#;", "&#x;", "&#xg", "a&b;c", "&notit; &notin; &amp;lt; &AMP &ampamp; AT&T &" + "n" * 40 + ";", "& amp;", "&\tlt;", "no reference"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(4)
    for r in rows.select("id", T.unescape(F.col("t")).alias("u")).collect():
        assert r.u == html.unescape(texts[r.id]), texts[r.id]
