"""CV checks and scores: facts of texts, ratios of checks as rows, and a roll-up with two denominators and caps.

Each text gets one row of facts; 43 checks turn it into ratios from 0 to 1, null where a check does not
apply. The ratios become rows (key, check, ratio) and are joined to the table of checks. A category's score
divides by the weights that apply; the headline scores give each check its fixed share of its category's
whole weight, so that a check that doesn't apply makes no other heavier. Quality is of the text alone,
relevance of a target. A text that parses badly is capped.

Null and empty texts have the facts of nothing. Layout facts that a text can't tell are those of a plain
text unless a table has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import band, clamp01
from ..functions.text import SPACE, STOP_WORDS
from . import frequency, resume, skills
from .relations import phrase_in, spaced_words

# Checks with category, weight, severity and, where it isn't the category's, scope.
CHECKS = {
    "text-layer": ("parse", 30, "critical", None),
    "single-column": ("parse", 22, "critical", None),
    "glyph-mapping": ("parse", 16, "critical", None),
    "hidden-text": ("parse", 12, "critical", None),
    "headings-detectable": ("parse", 10, "critical", None),
    "contact-in-body": ("parse", 6, "important", None),
    "fonts-embedded": ("parse", 8, "important", None),
    "table-chrome": ("parse", 6, "important", None),
    "name": ("contact", 22, "critical", None),
    "email": ("contact", 26, "critical", None),
    "phone": ("contact", 16, "important", None),
    "location": ("contact", 12, "important", None),
    "profile-link": ("contact", 14, "polish", None),
    "sensitive-fields": ("contact", 10, "polish", None),
    "department-link": ("contact", 12, "important", "relevance"),
    "core-sections": ("structure", 26, "critical", None),
    "roles-dated": ("structure", 22, "critical", None),
    "date-format": ("structure", 12, "polish", None),
    "bullets-per-role": ("structure", 22, "important", None),
    "section-order": ("structure", 10, "polish", None),
    "career-gaps": ("structure", 8, "polish", None),
    "department-section": ("structure", 12, "important", "relevance"),
    "quantified": ("impact", 32, "critical", None),
    "action-verbs": ("impact", 24, "important", None),
    "weak-openers": ("impact", 18, "important", None),
    "bullet-length": ("impact", 12, "polish", None),
    "verb-variety": ("impact", 8, "polish", None),
    "leadership-signal": ("impact", 6, "polish", None),
    "department-evidence": ("impact", 14, "critical", "relevance"),
    "jd-coverage": ("keywords", 45, "critical", None),
    "skills-listed": ("keywords", 30, "important", "quality"),
    "headline-matches-role": ("keywords", 15, "important", None),
    "weak-skill-claims": ("keywords", 10, "polish", "quality"),
    "department-skills": ("keywords", 25, "important", None),
    "first-person": ("language", 22, "important", None),
    "cliches": ("language", 24, "important", None),
    "tense-consistency": ("language", 20, "polish", None),
    "hedge-words": ("language", 16, "polish", None),
    "caps-abuse": ("language", 10, "polish", None),
    "bullet-punctuation": ("language", 8, "polish", None),
    "word-count": ("length", 55, "important", None),
    "page-count": ("length", 30, "important", None),
    "density": ("length", 15, "polish", None),
}
CATEGORIES = {"parse": (25, "quality"), "contact": (10, "quality"), "structure": (15, "quality"), "impact": (22, "quality"), "keywords": (15, "relevance"), "language": (8, "quality"), "length": (5, "quality")}
SEVERITIES = ("critical", "important", "polish")
GRADES = ((90, "A+"), (80, "A"), (68, "B"), (55, "C"), (40, "D"))
CAPS = ((25, 28), (50, 48), (70, 68))  # a parse score below the first number caps quality at the second
LENGTHS = {"student": (220, 550, 1), "entry": (280, 620, 1), "mid": (420, 900, 2), "senior": (600, 1150, 2), "executive": (650, 1350, 3)}
SUMMARY_CLICHES = ("team player", "hard worker", "detail-oriented", "results-driven", "self-motivated", "proven track record", "passionate about", "excellent communication skills")
HEDGED_SKILL = r"(?i)\b(familiar with|exposure to|basic understanding|working knowledge|some experience with)\b"

#: Facts of a file's layout, as a plain text has them; pages and glyphs follow from the text.
LAYOUT = {"image_pages": 0, "multi_column_pages": 0, "unmapped_glyphs": 0, "hidden_runs": 0, "contact_in_margin": 0, "fonts_not_embedded": 0, "vector_marks": 0}


def advert_coverage(cvs: DataFrame, key: str, text: str, adverts: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """key, term, n, place, present: the terms of each text's advert (adverts: key, advert), and whether the text has them.

    Terms join their texts by key; a term is there as a word, with an s more or less, or between word edges.
    """
    terms = frequency.keywords(adverts, key, "advert", known=known)
    each = terms.join(cvs.select(key, spaced_words(F.col(text)).alias("_words")), key)
    return each.select(key, "term", "n", "place", phrase_in(F.col("_words"), F.col("term")).alias("present"))


def facts(df: DataFrame, key: str, text: str, now: int, *, known: DataFrame | None = None, layout: DataFrame | None = None, targets: DataFrame | None = None, departments: DataFrame | None = None, adverts: DataFrame | None = None, known_terms: tuple[str, ...] = ()) -> DataFrame:
    """One row a text with all that the checks ask.

    known: skill. layout: key and columns of LAYOUT, pages and glyphs. targets: key, target_role, department.
    departments: department, link, section, core_skills, outcome_words. adverts: key, advert.
    """
    rows = resume.rows(resume.held(resume.lines(df, key, text), key, 2), key)
    marked = resume.rows(resume.held(resume.marked_lines(resume.role_lines(rows, key, now), key), key, 1), key)
    jobs = resume.roles(marked, key)
    line, section = F.col("line"), F.struct("line_no", "line")
    summary = F.array_sort(F.collect_list(F.when((F.col("section") == "summary") & F.col("heading").isNull(), section)))
    of_lines = rows.groupBy(key).agg(
        F.sum(F.size(F.split("line", rf"{SPACE}+"))).alias("words"),
        (F.sum(F.length("line")) + F.count("*") - 1).alias("chars"),
        F.array_sort(F.collect_list(F.when(F.col("heading").isNotNull(), F.struct("line_no", "heading")))).alias("headings"),
        F.array_join(F.transform(summary, lambda x: x["line"]), "\n").alias("summary"),
        F.count_if((F.length("line") > 30) & (line == F.upper(line)) & line.rlike("[A-Z]{4,}")).alias("shouted"),
        F.count_if(line.rlike(HEDGED_SKILL)).alias("hedged_skills"),
    )
    source, dated = F.col("source"), F.col("dates").isNotNull()
    current, n_bullets = F.coalesce(F.col("dates.current"), F.lit(False)), F.size("bullets")
    of_roles = jobs.groupBy(key).agg(
        F.count("*").alias("roles"),
        F.count_if(source == "experience").alias("jobs"),
        F.count_if((source == "experience") & dated).alias("dated_jobs"),
        F.max(dated).alias("any_dated"),
        F.size(F.array_distinct(F.flatten(F.collect_list("dates.formats")))).alias("date_formats"),
        F.count_if((n_bullets == 0) & (F.col("prose_words") > 40)).alias("prose_roles"),
        F.count_if(n_bullets > 8).alias("long_roles"),
        F.count_if(n_bullets == 0).alias("empty_roles"),
        F.sum(F.when(dated & ~current, F.col("n_present")).otherwise(0)).alias("past_in_present"),
        F.min(F.when(current, F.struct("role_no", ((F.col("n_past") > 0) & (F.col("n_present") > 0)).alias("mixed")))).alias("now"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role_no", F.coalesce("title", "header").alias("t")))), lambda x: x["t"]), " | ").alias("titles"),
    )
    b = marked.where("is_bullet")
    if targets is not None and departments is not None:
        b = b.join(targets.select(key, "department").join(departments.select("department", "outcome_words"), "department").drop("department"), key, "left")
        relevant = (F.size("metrics") > 0) & F.exists(F.coalesce("outcome_words", F.array().cast("array<string>")), lambda w: F.contains(F.lower("bullet"), w))
    else:
        relevant = F.lit(False)
    of_bullets = b.groupBy(key).agg(
        F.count("*").alias("bullets"),
        F.count_if(F.size("metrics") > 0).alias("measured"),
        F.count_if(F.col("verb").isNotNull()).alias("strong"),
        F.count_if(F.col("weak_opener").isNotNull()).alias("weak"),
        F.count_if((F.col("n_words") > 34) | (F.col("n_words") < 5)).alias("odd"),
        F.count_if("first_person").alias("first_person"),
        F.count_if(F.size("hedges") > 0).alias("hedgy"),
        F.count_if("stopped").alias("stopped"),
        F.count_if(F.col("verb_group") == "leadership").alias("leading"),
        F.array_distinct(F.flatten(F.collect_list("cliches"))).alias("cliches"),
        F.count_if(relevant).alias("relevant"),
    )
    verbs = resume.once(b, key, "verb").where("verb is not null").groupBy(key, "verb").agg(F.count("*").alias("n")).groupBy(key).agg(F.count_if(F.col("n") >= 3).alias("repeated"), F.sum("n").alias("verbs"))
    named = skills.cv_skills(df, key, text, known) if known is not None else skills.listed_skills(df, key, text, rows)
    of_skills = named.groupBy(key).agg(F.count("*").alias("skills"))
    out = df.select(key)
    for part in (of_lines, of_roles, of_bullets, verbs, of_skills, resume.experience(jobs, key), resume.contact(rows, key)):
        out = out.join(part, key, "left")
    if targets is not None:
        out = out.join(targets.select(key, "target_role", "department"), key, "left")
    if departments is not None and targets is not None:
        out = out.join(departments.select("department", "link", F.col("section").alias("wanted_section")), "department", "left")
        wanted = departments.select("department", F.explode("core_skills").alias("skill"))
        held = skills.field_skills(df.join(targets.select(key, "department"), key), key, text, "department", wanted)
        out = out.join(held.select(key, F.col("n_wanted").alias("core_skills"), F.size("present").alias("core_present")), key, "left")
    if adverts is not None:
        cover = advert_coverage(df, key, text, adverts, known_terms).groupBy(key).agg(F.count("*").alias("terms"), F.count_if("present").alias("terms_present"))
        out = out.join(cover, key, "left")
    if layout is not None:
        out = out.join(layout.select(key, *(F.col(c).alias(f"own_{c}") for c in layout.columns if c in {*LAYOUT, "pages", "glyphs"})), key, "left")
    have = set(out.columns)
    none = lambda kind: F.lit(None).cast(kind)
    optional = {"target_role": "string", "department": "string", "link": "string", "wanted_section": "string", "core_skills": "int", "core_present": "int", "terms": "long", "terms_present": "long"}
    out = out.withColumns({c: none(kind) for c, kind in optional.items() if c not in have} | {f"own_{c}": none("double") for c in (*LAYOUT, "pages", "glyphs") if f"own_{c}" not in have})
    counts = "words chars shouted hedged_skills roles jobs dated_jobs date_formats prose_roles long_roles empty_roles past_in_present bullets measured strong weak odd first_person hedgy stopped leading relevant repeated verbs skills months n_gaps".split()
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("double") for c in counts} | {c: F.coalesce(f"own_{c}", F.lit(n)).cast("double") for c, n in LAYOUT.items()})
    kinds = F.coalesce(F.transform("headings", lambda h: h["heading"]), F.array().cast("array<string>"))
    out = out.withColumn("kinds", kinds)
    has = lambda k: F.array_contains("kinds", k)
    level = skills.seniority(F.col("titles"), F.col("months"), dated=F.coalesce("any_dated", F.lit(False)), education=has("education"), experience=has("experience"))
    pages = F.coalesce(F.col("own_pages"), F.greatest(F.lit(1.0), F.floor(F.col("words") / 500 + 0.5)))
    return out.withColumns({"seniority": level, "pages": pages, "glyphs": F.coalesce(F.col("own_glyphs"), F.col("chars"))})


def ratios(f: DataFrame, key: str) -> DataFrame:
    """key, check, ratio of a table of facts; what doesn't apply has no row."""
    c, null = F.col, F.lit(None).cast("double")
    has = lambda k: F.array_contains("kinds", k)
    is_in = lambda *levels: c("seniority").isin(*levels)
    given = lambda x: F.when(x.isNotNull(), 1.0).otherwise(0.0)
    known_department = c("department").isNotNull() & c("link").isNotNull()
    by_level = lambda i: F.coalesce(*(F.when(c("seniority") == k, float(v[i])) for k, v in LENGTHS.items()))
    n, pages = c("bullets"), c("pages")
    share = lambda x: c(x) / F.nullif(n, F.lit(0.0))
    missing = sum((F.when(has(k), 0).otherwise(1) for k in ("experience", "education", "skills", "summary")), F.lit(0))
    counted = missing - F.when(is_in("student") & ~has("experience"), 1).otherwise(0)
    place = lambda k: F.array_position("kinds", k)
    young = is_in("student", "entry")
    in_order = F.when(young, place("education") < place("experience")).otherwise(place("experience") < place("education"))
    per_page, least, most = c("words") / F.greatest(pages, F.lit(1.0)), by_level(0), by_level(1)
    mixed = F.coalesce(c("now.mixed"), F.lit(False))
    said = F.concat(F.coalesce("cliches", F.array().cast("array<string>")), F.filter(F.array(*map(F.lit, SUMMARY_CLICHES)), lambda w: F.contains(F.lower(F.coalesce("summary", F.lit(""))), w)))
    target = F.lower(F.trim(F.coalesce("target_role", F.lit(""))))
    wanted = F.filter(F.split(target, rf"{SPACE}+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    top = F.lower(F.concat(F.coalesce("headline", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))))
    hit = F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, lambda w: F.contains(top, w))) / F.nullif(F.size(wanted), F.lit(0)))
    unmapped = c("unmapped_glyphs") / F.nullif(c("glyphs"), F.lit(0.0))
    marks = c("vector_marks") / F.greatest(pages, F.lit(1.0))
    link_there = F.when(c("link") == "repository", c("github").isNotNull() | c("website").isNotNull()).otherwise(c("website").isNotNull())
    stop = share("stopped")
    ratio = {
        "text-layer": F.when(c("glyphs") >= 400, 1.0).when(c("glyphs") < 40, 0.0).otherwise(band(c("glyphs"), 40, 400) * 0.5),
        "single-column": F.when(c("multi_column_pages") == 0, 1.0).otherwise(clamp01(1 - c("multi_column_pages") / pages) * 0.35),
        "glyph-mapping": F.when(c("glyphs") == 0, 0.0).when(unmapped < 0.005, 1.0).otherwise(1 - unmapped * 6),
        "hidden-text": F.when(c("hidden_runs") == 0, 1.0).otherwise(0.0),
        "headings-detectable": (3 - sum((F.when(has(k), 0).otherwise(1) for k in ("experience", "education", "skills")), F.lit(0))) / 3.0,
        "contact-in-body": F.when((c("contact_in_margin") > 0) & c("email").isNotNull(), 0.2).otherwise(1.0),
        "fonts-embedded": 1 - c("fonts_not_embedded") / 4,
        "table-chrome": F.when(marks < 45, 1.0).otherwise(1 - (marks - 45) / 180),
        "name": given(c("name")),
        "email": given(c("email")),
        "phone": given(c("phone")),
        "location": given(c("location")),
        "profile-link": given(F.coalesce("linkedin", "github", "website")),
        "sensitive-fields": 1 - F.coalesce(F.size("sensitive"), F.lit(0)) / 4.0,
        "department-link": F.when(known_department & ~c("link").isin("none", "profile"), F.when(link_there, 1.0).otherwise(0.0)),
        "core-sections": F.when(missing == 0, 1.0).when(counted == 0, 0.9).otherwise(1 - counted / 4.0),
        "roles-dated": F.when(c("roles") == 0, 0.0).when(c("jobs") > 0, c("dated_jobs") / c("jobs")),
        "date-format": F.when(c("date_formats") <= 1, 1.0).otherwise(1 - (c("date_formats") - 1) / 3),
        "bullets-per-role": F.when(c("roles") == 0, 0.5).when(c("prose_roles") > 0, 1 - c("prose_roles") / c("roles")).when(c("long_roles") > 0, 1 - c("long_roles") / c("roles") / 2).otherwise(1 - c("empty_roles") / c("roles")),
        "section-order": F.when(has("experience") & has("education"), F.when(in_order, 1.0).otherwise(0.4)),
        "career-gaps": F.when(c("n_gaps") == 0, 1.0).otherwise(0.55),
        "department-section": F.when(c("wanted_section").isNotNull(), F.when(F.array_contains("kinds", c("wanted_section")), 1.0).when((c("wanted_section") != "projects") | young, 0.2)),
        "quantified": F.when(n == 0, 0.0).otherwise(band(share("measured"), 0, 0.45)),
        "action-verbs": F.when(n == 0, 0.0).otherwise(band(share("strong"), 0.2, 0.85)),
        "weak-openers": F.when(n == 0, 0.5).otherwise(1 - share("weak") * 2.2),
        "bullet-length": F.when(n == 0, 0.5).otherwise(1 - share("odd") / 0.6),
        "verb-variety": F.when(c("verbs") >= 5, 1 - c("repeated") / 4),
        "leadership-signal": F.when(is_in("senior", "executive"), F.when(c("leading") > 0, 1.0).otherwise(0.3)),
        "department-evidence": F.when(known_department, F.when(n == 0, 0.5).otherwise(band(c("relevant"), 0, 3))),
        "jd-coverage": F.when(c("terms") > 0, band(c("terms_present") / c("terms"), 0.15, 0.7)),
        "skills-listed": F.when(c("skills") > 40, 0.5).otherwise(band(c("skills"), 0, 8)),
        "headline-matches-role": F.when(F.length(target) >= 3, band(hit, 0, 0.6)),
        "weak-skill-claims": 1 - c("hedged_skills") / 5,
        "department-skills": F.when(c("core_skills") > 0, band(c("core_present") / c("core_skills"), 0, 0.3)),
        "first-person": 1 - c("first_person") / F.greatest(F.lit(4.0), n / 3),
        "cliches": 1 - F.size(F.array_distinct(said)) / 5.0,
        "tense-consistency": 1 - (c("past_in_present") + F.when(mixed, 2).otherwise(0)) / F.greatest(F.lit(1.0), n) / 0.5,
        "hedge-words": 1 - c("hedgy") / F.greatest(F.lit(6.0), n) / 0.5,
        "caps-abuse": F.when(c("shouted") <= 1, 1.0).otherwise(1 - c("shouted") / 8),
        "bullet-punctuation": F.when(n >= 4, F.when((stop <= 0.15) | (stop >= 0.85), 1.0).otherwise(0.5)),
        "word-count": F.when(c("words") < least, clamp01((c("words") - least * 0.4) / (least * 0.6))).when(c("words") <= most, 1.0).otherwise(1 - (c("words") - most) / most),
        "page-count": F.when(pages <= by_level(2), 1.0).otherwise(1 - (pages - by_level(2)) / 3),
        "density": F.when(per_page < 260, band(per_page, 90, 260)).when(per_page <= 700, 1.0).otherwise(1 - (per_page - 700) / 400),
    }
    # least and greatest pass over nulls, which must stay
    bounded = [F.when(r.isNotNull(), clamp01(r)).otherwise(null).alias(k) for k, r in ratio.items()]
    wide = f.select(key, *bounded)
    return wide.unpivot(key, [F.col(f"`{k}`") for k in CHECKS], "check", "ratio").where("ratio is not null")


def check_table(spark) -> DataFrame:
    """check, category, weight, severity, scope, share (of 100 points), category_weight."""
    total = {name: sum(w for c, w, _, _ in CHECKS.values() if c == name) for name in CATEGORIES}
    rows = [(k, c, w, s, scope or CATEGORIES[c][1], w / total[c] * CATEGORIES[c][0], CATEGORIES[c][0]) for k, (c, w, s, scope) in CHECKS.items()]
    return spark.createDataFrame(rows, "check string, category string, weight int, severity string, scope string, share double, category_weight int")


def half_up(c: Column, digits: int = 0) -> Column:
    """Halves go up, after what sums leave beyond nine digits is gone."""
    return F.floor(F.round(c * 10**digits, 9) + 0.5) / 10**digits


def grade(score: Column) -> Column:
    out = F.lit("F")
    for least, letter in reversed(GRADES):
        out = F.when(score >= least, letter).otherwise(out)
    return F.when(score.isNotNull(), out)


def roll_up(long: DataFrame, key: str) -> DataFrame:
    """key, score, grade, relevance, relevance_grade and each category's score, from rows of (key, check, ratio).

    One aggregate: a row a check and text comes in, a row a text goes out. relevance is null where nothing
    of it applies; a category of which nothing applies has 100.
    """
    rows = long.join(F.broadcast(check_table(long.sparkSession)), "check")  # 43 rows
    r, w, share = F.col("ratio"), F.col("weight"), F.col("share")
    when = lambda column, value, x: F.sum(F.when(F.col(column) == value, x))
    sums = [f(column, value).alias(f"_{column}_{value}_{part}") for column, values in (("category", CATEGORIES), ("scope", ("quality", "relevance"))) for value in values for part, f in (("got", lambda a, b: when(a, b, r * (w if a == "category" else share))), ("of", lambda a, b: when(a, b, w if a == "category" else share)))]
    out = rows.groupBy(key).agg(*sums)
    part = lambda name: 100 * F.col(f"{name}_got") / F.col(f"{name}_of")
    by = {c: F.coalesce(half_up(part(f"_category_{c}")), F.lit(100.0)).cast("int") for c in CATEGORIES}
    overall = F.coalesce(part("_scope_quality"), F.lit(0.0))
    cap = F.coalesce(*(F.when(by["parse"] < least, most) for least, most in CAPS), F.lit(100)).cast("double")
    score = half_up(F.least(overall, cap)).cast("int")
    relevance = half_up(part("_scope_relevance")).cast("int")
    out = out.withColumns({"score": score, "relevance": relevance})
    return out.select(key, "score", grade(F.col("score")).alias("grade"), "relevance", grade(F.col("relevance")).alias("relevance_grade"), *(by[c].alias(c) for c in CATEGORIES))


def findings(long: DataFrame, key: str) -> DataFrame:
    """key, check, category, severity, points_lost of the checks that cost something."""
    rows = long.join(F.broadcast(check_table(long.sparkSession)), "check").where("ratio < 0.999")
    return rows.select(key, "check", "category", "severity", half_up((1 - F.col("ratio")) * F.col("share"), 1).alias("points_lost"))


def report(scores: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, markdown: a text's scores, and its findings by severity, then by what they cost, then by check."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    line = F.format_string("- **%s** %s (%s): -%.1f", F.col("severity"), "check", "category", "points_lost")
    lines = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), (-F.col("points_lost")).alias("lost"), F.col("check"), line.alias("line")))).alias("found"))
    listed = F.coalesce(F.array_join(F.transform("found", lambda x: x["line"]), "\n"), F.lit("- nothing"))
    relevance = F.when(F.col("relevance").isNull(), "").otherwise(F.format_string("Relevance %d (%s)\n\n", "relevance", "relevance_grade"))
    head = F.concat(F.format_string("# Score %d (%s)\n\n", "score", "grade"), relevance)
    table = F.concat(F.lit("| Category | Score |\n| --- | --- |\n"), *(F.format_string(f"| {c} | %d |\n", c) for c in CATEGORIES))
    return scores.join(lines, key, "left").select(key, F.concat(head, table, F.lit("\n## Findings\n\n"), listed, F.lit("\n")).alias("markdown"))


# How much of each part a review may be given.
REVIEW = {"cv": 9000, "advert": 2500, "role": 120, "issues": 14, "terms": 20, "bullets": 14}
#: What is taken out of a CV before a review: addresses, and numbers with a country's code or in three groups.
SCRUBBED = (
    (resume.EMAIL, "[email removed]"),
    (r"\+\d[\d\s().-]{8,16}\d", "[phone removed]"),
    (r"(?<![A-Za-z0-9_])\d{3}[\s.-]\d{3}[\s.-]\d{4}(?![A-Za-z0-9_])", "[phone removed]"),
)


def scrubbed(text: Column) -> Column:
    for pattern, to in SCRUBBED:
        text = F.regexp_replace(text, pattern, to)
    return text


def review_payload(df: DataFrame, key: str, text: str, now: int, found: DataFrame, terms: DataFrame) -> DataFrame:
    """key, cv (scrubbed), issues, missing_terms, weak_bullets of each text, each within its limit.

    found: findings, in whose order the issues come; terms: of advert_coverage. A bullet is weak that says
    no number, opens weakly or opens without an action verb.
    """
    marked = resume.marked_lines(resume.role_lines(resume.lines(df, key, text), key, now), key)
    marked = resume.once(marked.where("is_bullet"), key, "line_no", "bullet", "metrics", "weak_opener", "verb")
    weak = marked.where((F.size("metrics") == 0) | F.col("weak_opener").isNotNull() | F.col("verb").isNull())
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    ordered = lambda rows, order, value, most, name: rows.groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda x: x["v"]), 1, most).alias(name))
    bullets = ordered(weak, ["line_no"], "bullet", REVIEW["bullets"], "weak_bullets")
    issues = ordered(found, [rank.alias("r"), (-F.col("points_lost")).alias("l")], "check", REVIEW["issues"], "issues")
    missing = ordered(terms.where(~F.col("present")), ["place"], "term", REVIEW["terms"], "missing_terms")
    out = df.select(key, F.substring(scrubbed(F.col(text)), 1, REVIEW["cv"]).alias("cv"))
    for part in (issues, missing, bullets):
        out = out.join(part, key, "left")
    none = F.array().cast("array<string>")
    return out.select(key, "cv", *(F.coalesce(c, none).alias(c) for c in ("issues", "missing_terms", "weak_bullets")))
