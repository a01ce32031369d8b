"""What course pages and their JSON say about admission: texts, tests, notes and records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitflow.functions.text import FLAGS, NOTES, blank_to_null, collapse, contains_any, first_place, language_tests, let, normal_text, section_window, strip_html, trimmed
from admitflow.session import fresh

#: The parts of a page's JSON that are read, as schemas; other fields are skipped by the reader.
MODEL = "struct<link:string,`:items`:struct<`nd-qualifications-pg`:struct<description:string,additionalText:string>,`nd-before-how-to-apply`:struct<description:string>,`nd-submit-how-to-apply`:struct<customOpenText:string>>>"
EXPLORER = (
    "struct<content:struct<`course-admission-requirement-rte`:struct<summary:string>,`nd-qualifications-pg`:struct<description:string,additionalText:string>,"
    "`course-applying-for-admission-rte`:struct<summary:string>,`course-how-to-apply`:struct<intHowToApply:string,intDateForSemester:string>,`course-opportunities-rte`:struct<summary:string>>>"
)
COREDATA = "struct<attributes:struct<entryRequirements:struct<entryRequirementsByYear:array<struct<entryRequirements:array<struct<description:string,codeDesc:string>>>>>>>"

#: What makes an academic text a good one, and what marks a text as a placeholder.
TEXT_MARKERS = ("admission", "eligible", "bachelor", "degree", "qualification", "honours", "master", "thesis", "experience", "graduate certificate", "graduate diploma", "cognate discipline", "equivalent qualification")
PLACEHOLDER = "for academic requirements check"
#: Markers of a sentence on applying, of the starts of blocks, and of notes.
APPLYING = ("limited places", "quota", "interview", "declaration form", "criminal record", "resume", "resumé", "referee", "portfolio", "personal statement")
ACADEMIC_STARTS = ("admission", "entry requirements", "academic requirements")
APPLICATION_STARTS = ("how to apply", "supplementary form", "portfolio", "limited places")
FALLBACK_NOTE = "Language requirements fell back to the central English requirements page."
#: Labels of the application flags in an index text.
FLAG_LABELS = {
    "requires_portfolio": "Portfolio required", "requires_personal_statement": "Personal statement required", "requires_supplementary_form": "Supplementary form required",
    "requires_cv_or_resume": "CV or resume required", "requires_references": "References required", "requires_work_experience": "Work experience required",
    "limited_places": "Limited places", "quota_applies": "Quota applies",
}
PARTS = ("listening", "reading", "speaking", "writing")
TEST = "struct<test_name:string,overall:string,component_scores:map<string,string>,raw_text:string,source_url:string,source_type:string,source_priority:int>"


#: Start and end markers of a page's blocks. (One end marker of the application block names a place; pass it in ``more_ends``.)
BLOCKS = {
    "academic": (
        ("admission requirement", "admission requirements", "academic requirements", "entry requirements", "admission to candidature"),
        ("credit for previous study", "how to apply", "fees", "careers", "what you'll study", "what you will study", "requirements for award"),
    ),
    "language": (
        ("english language proficiency", "english language requirement", "english requirements", "english language skills"),
        ("how to apply", "fees", "credit for previous study", "admission requirement"),
    ),
    "application": (
        ("how to apply", "applications are made", "additional admission criteria", "limited places", "quota applies", "supplementary form", "portfolio"),
        ("careers", "what you'll study", "fees"),
    ),
}


def blocks(text: Column, more_ends: tuple[str, ...] = (), length: int = 2400) -> Column:
    """struct<academic, language, application>: each from its earliest start marker to the earliest end marker behind it, else ``length`` characters; empty without a start."""

    def of(clean: Column) -> Column:
        return F.struct(*(section_window(clean, starts, ends + (more_ends if name == "application" else ()), length).alias(name) for name, (starts, ends) in BLOCKS.items()))

    return let(normal_text(text), of)


def fallback_academic(text: Column, length: int = 2400) -> Column:
    """From the earliest marker (else the start) to "requirements for award", else ``length`` characters."""
    low = F.lower(text)

    def of(start: Column) -> Column:
        end = F.nullif(F.call_function("locate", F.lit("requirements for award"), low, start), F.lit(0))
        return F.trim(F.substring(text, start, F.coalesce(end - start, F.lit(length))))

    return let(F.coalesce(first_place(low, ACADEMIC_STARTS), F.lit(1)), of)


def fallback_application(text: Column, length: int = 1400) -> Column:
    """``length`` characters from the earliest marker, else from the start."""
    return F.trim(F.substring(text, F.coalesce(first_place(F.lower(text), APPLICATION_STARTS), F.lit(1)), F.lit(length)))


def supplementary_metadata(text: Column, most: int = 5) -> Column:
    """struct<program_rules, award_requirements_detected, rpl_detected>: the first sentences on credit points, and two markers."""
    low = F.lower(text)
    sentences = F.regexp_extract_all(text, F.lit(r"(?i)[^.]*credit points[^.]*\.?"), F.lit(0))
    return F.struct(
        F.slice(F.transform(sentences, lambda s: F.trim(s)), 1, most).alias("program_rules"),
        low.contains("requirements for award").alias("award_requirements_detected"),
        contains_any(low, ("credit for previous study", "recognition of prior learning")).alias("rpl_detected"),
    )


def best_text(candidates: Column) -> Column:
    """The candidate of most characters plus 100 a marker, cut at "english requirements"; placeholders don't count, the first of equals wins; empty without any."""

    def scored(t: Column, place: Column) -> Column:
        head = F.trim(F.regexp_extract(t, r"(?is)^(.*?)(?:english requirements|$)", 1))
        cut = F.when(head == "", t).otherwise(head)
        score = F.length(cut) + 100 * sum(F.lower(cut).contains(m).cast("int") for m in TEXT_MARKERS)
        return F.struct(score.alias("score"), (-place).alias("place"), cut.alias("text"))

    clean = F.filter(F.transform(candidates, normal_text), lambda t: (t != "") & ~F.lower(t).contains(PLACEHOLDER))
    return F.coalesce(F.array_max(F.transform(clean, scored))["text"], F.lit(""))


def application_sentences(texts: Column) -> Column:
    """The texts that hold a marker of applying, joined."""
    return normal_text(F.array_join(F.filter(texts, lambda t: contains_any(F.lower(t), APPLYING)), " "))


def english_section(text: Column) -> Column:
    """From "english requirement" to the phrase that ends it, or the end."""
    return normal_text(F.regexp_extract(text, r"(?is)english requirements?.*?(?:important information|credit for previous study|$)", 0))


def first_year(coredata: Column) -> Column:
    """Entry requirements of the first year; empty where there are none."""
    years = coredata["attributes"]["entryRequirements"]["entryRequirementsByYear"]
    return F.coalesce(F.get(years, F.lit(0))["entryRequirements"], F.array().cast("array<struct<description:string,codeDesc:string>>"))


def structured_tests(coredata: Column) -> Column:
    """array of tests with their scores from the structured requirements of the first year."""

    def test(r: Column) -> Column:
        return let(F.transform(F.array(r["codeDesc"], r["description"]), normal_text), lambda x: read(F.lower(F.get(x, F.lit(0))), F.get(x, F.lit(1))))

    def read(code: Column, text: Column) -> Column:
        name = F.when(code.contains("ielts"), "IELTS Academic").when(code.contains("toefl"), "TOEFL iBT").when(contains_any(code, ("pearsons", "pte")), "PTE Academic")

        def of(numbers: Column) -> Column:
            band = F.coalesce(blank_to_null(F.regexp_extract(text, r"(?i)minimum result of (\d+(?:\.\d+)?) in each band", 1)), F.get(numbers, F.lit(1)))
            in_turn = ("reading", "listening", "writing", "speaking")
            by_place = F.create_map(*[x for k, n in enumerate(in_turn) for x in (F.lit(n), F.get(numbers, F.lit(k + 1)))])
            by_band = F.create_map(*[x for n in PARTS for x in (F.lit(n), band)])
            parts = F.map_filter(F.when(name == "TOEFL iBT", by_place).otherwise(by_band), lambda _, v: v.isNotNull())
            return F.struct(
                name.alias("test_name"), F.get(numbers, F.lit(0)).alias("overall"), parts.alias("component_scores"), text.alias("raw_text"),
                F.lit("").alias("source_url"), F.lit("explicit_course_page").alias("source_type"), F.lit(1).alias("source_priority"),
            ).cast(TEST)

        return F.when(name.isNotNull(), let(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), of))

    return F.filter(F.transform(first_year(coredata), test), lambda t: t.isNotNull())


def tests_with_fallback(own: Column, central: Column, url: Column, central_url: Column) -> Column:
    """Tests of the course's own text (priority 1), else of the central one (priority 4)."""

    def of(text: Column, where: Column, kind: str, priority: int) -> Column:
        def test(t: Column) -> Column:
            bands = F.create_map(*[x for n in PARTS for x in (F.lit(n), t["band"])])
            parts = F.map_filter(bands, lambda _, v: v.isNotNull())
            return F.struct(t["test_name"].alias("test_name"), t["overall"].alias("overall"), parts.alias("component_scores"), text.alias("raw_text"), where.alias("source_url"), F.lit(kind).alias("source_type"), F.lit(priority).alias("source_priority")).cast(TEST)

        return F.transform(language_tests(text), test)

    none = F.array().cast(f"array<{TEST}>")
    return (
        F.when(F.coalesce(own, F.lit("")) != "", of(own, url, "explicit_course_page", 1))
        .when(F.coalesce(central, F.lit("")) != "", of(central, central_url, "global_standard_reference", 4))
        .otherwise(none)
    )


def derived_notes(text: Column, fell_back: Column) -> Column:
    low = F.lower(text)
    mentions = [F.when(low.contains(m), f"Course page mentions {m}.") for m in NOTES[:2]]
    return F.array_compact(F.array(*mentions, F.when(fell_back, FALLBACK_NOTE)))


def page_requirements(rows: DataFrame, model: Column, explorer: Column, coredata: Column, page_text: Column, central: Column, central_url: Column, name: str = "r") -> DataFrame:
    """``rows`` with a struct of the requirement texts of a page's JSON, each with where it comes from; what the JSON lacks is taken from the page's text.

    model, explorer and coredata: JSON text (null where a file is missing). The files are parsed in a first step, their texts freed of markup in a
    second, and chosen from in the next ones, so that nothing is worked out again for each text that it goes into.
    """
    own, col = fresh(rows), lambda x: F.col(f"{own}{x}")
    files = rows.withColumns({f"{own}m": F.from_json(model, MODEL), f"{own}e": F.from_json(explorer, EXPLORER), f"{own}c": F.from_json(coredata, COREDATA)})
    files = files.withColumns({f"{own}page": page_text, f"{own}central": F.coalesce(central, F.lit("")), f"{own}central_url": central_url})
    items, content = col("m")[":items"], col("e")["content"]
    quality = [source["nd-qualifications-pg"][f] for source in (items, content) for f in ("description", "additionalText")]
    how = content["course-how-to-apply"]
    admission, applying, chances = (content[f"course-{x}-rte"]["summary"] for x in ("admission-requirement", "applying-for-admission", "opportunities"))
    html = [admission, *quality, items["nd-before-how-to-apply"]["description"], items["nd-submit-how-to-apply"]["customOpenText"], applying, how["intHowToApply"], how["intDateForSemester"], chances]
    asked = F.array_join(F.transform(first_year(col("c")), lambda r: r["description"]), " ")
    texts = files.withColumns({
        f"{own}texts": F.transform(F.array(*html), strip_html), f"{own}own": normal_text(asked), f"{own}link": F.coalesce(col("m")["link"], F.lit("")), f"{own}tests": structured_tests(col("c")),
    })
    text_at = lambda k: F.get(col("texts"), F.lit(k))
    n = 1 + len(quality)
    chosen = texts.withColumns({
        f"{own}academic": best_text(F.slice(col("texts"), 1, n)),
        f"{own}language": F.coalesce(blank_to_null(col("own")), blank_to_null(english_section(text_at(0))), col("central")),
    })
    more = application_sentences(F.array(col("academic"), text_at(len(html) - 1), text_at(n + 2)))
    parts = F.filter(F.concat(F.slice(col("texts"), n + 1, 5), F.array(more)), lambda x: x != "")
    joined = chosen.withColumn(f"{own}application", normal_text(F.array_join(parts, " ")))
    link = col("link")
    beside = lambda suffix: F.when(link.endswith(".html"), F.concat(F.regexp_replace(link, r"\.html$", ""), F.lit(suffix))).otherwise(link)
    told = F.struct(
        F.coalesce(blank_to_null(col("academic")), fallback_academic(col("page"))).alias("academic_text"), col("language").alias("language_text"),
        F.coalesce(blank_to_null(col("application")), fallback_application(col("page"))).alias("application_text"), col("tests").alias("language_tests"),
        normal_text(F.array_join(F.filter(F.array(col("academic"), col("application")), lambda x: x != ""), " ")).alias("supplementary_text"),
        beside(".coredata.json").alias("academic_source_url"), beside(".model.json").alias("application_source_url"),
        F.when(link.endswith(".html") & (F.size(col("tests")) > 0), beside(".explorer.json")).otherwise(F.when(col("central") != "", col("central_url")).otherwise(link)).alias("language_source_url"),
    )
    return joined.select(*(F.col(f"`{c}`") for c in rows.columns), told.alias(name))


def requirement_details(tests: Column, pathways: Column, details: Column, metadata: Column, source_map: Column, notes: Column) -> Column:
    """The detail document of a requirement, as JSON text; sub-scores are those of the last IELTS test."""
    ielts = F.try_element_at(F.filter(tests, lambda t: t["test_name"] == "IELTS Academic"), F.lit(-1))["component_scores"]
    parts = F.coalesce(ielts, F.create_map().cast("map<string,string>"))
    return F.to_json(F.struct(
        tests.alias("language_tests"), pathways.alias("academic_pathways"), details.alias("application_details"), metadata.alias("supplementary_metadata"),
        source_map.alias("source_map"), notes.alias("source_notes"), parts.alias("ielts_subscores"),
    ))


def application_index_text(raw: Column, details: Column) -> Column:
    """The index text of application details: raw text, documents, flags that are set, and notes."""

    def listed(label: str, values: Column) -> Column:
        clean = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), collapse), lambda x: x != "")
        return F.when(F.size(clean) > 0, F.concat(F.lit(f"{label}: "), F.array_join(clean, "; ")))

    flags = F.array_compact(F.array(*(F.when(F.coalesce(details[f], F.lit(False)), label) for f, label in FLAG_LABELS.items())))
    return collapse(F.concat_ws(" ", blank_to_null(collapse(raw)), listed("Required documents", details["required_documents"]), listed("Application flags", flags), listed("Selection notes", details["selection_notes"])))


def backfilled_parts(details: Column, min_band: Column) -> Column:
    """struct of the four parts: from the sub-scores of the detail document, else the minimum band; null where there is neither."""
    has = min_band.isNotNull() | F.get_json_object(details, "$.ielts_subscores").isNotNull()
    return F.struct(*(F.when(has, F.coalesce(F.get_json_object(details, f"$.ielts_subscores.{p}").try_cast("double"), min_band)).alias(p) for p in PARTS))


#: Labels of the flags in a listing, in order.
LISTING_FLAGS = {
    "limited_places": "Limited places", "quota_applies": "Quota applies", "requires_portfolio": "Portfolio", "requires_personal_statement": "Personal statement", "requires_supplementary_form": "Supplementary form",
    "requires_cv_or_resume": "CV/Resume", "requires_references": "References", "requires_work_experience": "Work experience",
}


def dashboard_columns(
    source: Column, crawl_source: str, text: Column, tests: Column, details: Column, url: Column, rpl: Column | None = None, limit: int = 140, labels: tuple[str, str] = ("官网爬取", "Excel / 原始导入")
) -> dict[str, Column]:
    """What a listing shows beside a course: where its data is from, short texts, and a column a flag. rpl: whether earlier learning counts."""
    crawled = F.coalesce(source == crawl_source, F.lit(False))
    shown = F.array_join(F.transform(F.filter(tests, lambda t: F.coalesce(t["test_name"], F.lit("")) != ""), lambda t: F.concat_ws(" ", t["test_name"], blank_to_null(t["overall"]))), " | ")
    flags = [F.when(F.coalesce(details[f], F.lit(False)), lab) for f, lab in LISTING_FLAGS.items()]
    flags += [] if rpl is None else [F.when(rpl, "RPL / Credit")]
    papers = F.filter(F.coalesce(details["required_documents"], F.array().cast("array<string>")), lambda d: d != "")
    return {
        "has_crawled_admissions": crawled,
        "admission_source_label": F.when(crawled, labels[0]).otherwise(labels[1]),
        "language_tests_display": shown,
        "required_documents_display": F.array_join(papers, ", "),
        "application_flags_display": F.array_join(F.array_compact(F.array(*flags)), ", "),
        "academic_summary": trimmed(text, limit, "…"),
        "source_url_display": F.coalesce(url, F.lit("")),
        **{f: F.coalesce(details[f], F.lit(False)) for f in FLAGS},
    }
