"""Survey answers (``map<string,array<string>>``) to demographics, weighted tags and labels.

Expression builders take and return Spark SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.engagement import age_bucket
from recspark.functions.labels import sql_text

# ---------------------------------------------------------------------------------------
# Event names, question ids, answer codes and their taxonomy labels.
# ---------------------------------------------------------------------------------------
SURVEY_EVENTS = ("SURVEY_SUBMITTED", "SURVEY_ANSWERED")
DEMOGRAPHIC_EVENTS = SURVEY_EVENTS + ("IDENTIFY",)

QUESTIONS = {
    "age": ("q:age", "age_group", "age"),
    "gender": ("q:gender", "gender"),
    "nationality": ("q:nationality", "nationality", "country"),
    "province": ("q:province", "province", "region", "q:nationality_province", "nationality_province"),
    "personal_connection": ("q:ww2_connection", "personal_connection"),
}
DEMO_FIELDS = (*QUESTIONS, "email_shared")

PERSONALIZATION = {
    "q:personalization_theme": "theme_what",
    "personalization_theme": "theme_what",
    "q:personalization_interest": "theme_how.type_of_stores",
    "personalization_interest": "theme_how.type_of_stores",
    "q:personalization_area": "place_where.camp_areas",
    "personalization_area": "place_where.camp_areas",
}
AREA_FACET = "place_where.camp_areas"

AGE_LABELS = {
    "under_18": "child", "under_16": "child",
    "16_18": "age 16-18", "18_24": "age 18-24", "25_34": "age 25-34",
    "35_44": "age 35-44", "45_54": "age 45-54", "55_64": "age 55-64",
    "65_74": "age 65-74", "75_84": "age 75-84", "85_plus": "age 85+",
    "65_plus": "elderly",
}
GENDER_LABELS = {"female": "female", "male": "Male", "non_binary": "non-binary"}
CORE_COUNTRIES = ("netherlands", "germany", "poland")
DEMONYM_COUNTRY = {
    "dutch": "Netherlands", "german": "Germany", "polish": "Poland", "belgian": "Belgium",
    "french": "France", "british": "United Kingdom", "american": "United States",
    "israeli": "Israel", "canadian": "Canada", "danish": "Denmark", "swedish": "Sweden",
    "norwegian": "Norway", "finnish": "Finland", "irish": "Ireland", "spanish": "Spain",
    "italian": "Italy", "portuguese": "Portugal", "greek": "Greece", "austrian": "Austria",
    "swiss": "Switzerland", "czech": "Czechia", "ukrainian": "Ukraine", "russian": "Russia",
    "turkish": "Turkey", "moroccan": "Morocco", "japanese": "Japan", "chinese": "China",
    "indian": "India", "brazilian": "Brazil", "australian": "Australia", "afghan": "Afghanistan",
    "albanian": "Albania", "new_zealander": "New Zealand",
}
PREFERENCE_ALIASES = {
    "forced labour": "Forced Labor",
    "forced labor": "Forced Labor",
    "liberation": "Liberation",
    "deportation": "Deportation",
    "daily life": "Daily Life",
    "personal stories": "Personal stories",
    "resistance": "Resistance",
}
DEMO_CANON = {
    "gender": {
        "f": "female", "vrouw": "female", "m": "male", "man": "male", "nonbinary": "non_binary",
        "x": "non_binary", "prefer_not_to_say": "no_answer", "geen_antwoord": "no_answer",
    },
    "email_shared": {"ja": "yes", "true": "yes", "nee": "no", "false": "no"},
    "personal_connection": {
        "ja": "yes", "nee": "no", "ik_weet_het_niet": "unknown", "weet_niet": "unknown",
        "i_dont_know": "unknown", "idk": "unknown", "dont_know": "unknown",
        "i_do_not_want_to_answer": "no_answer", "i_dont_want_to_answer": "no_answer",
        "ik_wil_geen_antwoord_geven": "no_answer", "geen_antwoord": "no_answer",
        "prefer_not_to_say": "no_answer", "liever_niet": "no_answer",
    },
    "nationality": {
        "nederlandse": "dutch", "belgische": "belgian", "duitse": "german", "franse": "french",
        "poolse": "polish", "britse": "british", "netherlands": "dutch", "belgium": "belgian",
        "germany": "german", "france": "french", "poland": "polish", "uk": "british",
        "united_kingdom": "british", "new_zealand": "new_zealander", "nederlands": "dutch",
        "nederlander": "dutch", "afghaan": "afghan", "afghaanse": "afghan",
        "albanees": "albanian", "albanese": "albanian", "amerikaan": "american",
        "amerikaanse": "american", "australiër": "australian", "australische": "australian",
        "braziliaan": "brazilian", "braziliaanse": "brazilian", "canadees": "canadian",
        "canadese": "canadian", "chinees": "chinese", "deen": "danish", "deense": "danish",
        "duitser": "german", "engels": "british", "engelse": "british", "brit": "british",
        "fin": "finnish", "finse": "finnish", "fransman": "french", "française": "french",
        "griek": "greek", "griekse": "greek", "ier": "irish", "ierse": "irish",
        "indiaas": "indian", "indiase": "indian", "israëliër": "israeli",
        "israelisch": "israeli", "israëlische": "israeli", "italiaan": "italian",
        "italiaanse": "italian", "japanner": "japanese", "japans": "japanese",
        "japanse": "japanese", "marokkaan": "moroccan", "marokkaanse": "moroccan",
        "noor": "norwegian", "noorse": "norwegian", "oostenrijker": "austrian",
        "oostenrijkse": "austrian", "oekraïens": "ukrainian", "oekraïense": "ukrainian",
        "pool": "polish", "portugees": "portuguese", "portugese": "portuguese",
        "rus": "russian", "russische": "russian", "spanjaard": "spanish", "spaans": "spanish",
        "spaanse": "spanish", "tsjech": "czech", "tsjechische": "czech", "turk": "turkish",
        "turkse": "turkish", "zweed": "swedish", "zweedse": "swedish", "zwitser": "swiss",
        "zwitserse": "swiss",
    },
}
DEMO_JUNK = ("select", "select___", "none", "null", "_", "n_a")
GENDER_CANONICAL = ("female", "male", "non_binary", "no_answer", "other")
LIKERT = {"1": "Strongly disagree", "2": "Disagree", "3": "Undecided", "4": "Agree", "5": "Strongly agree"}
YES_NO = {"yes": "Yes", "no": "No", "unknown": "Don't know"}
LIKERT_QUESTIONS = (
    "knowledge_level", "learned_something", "interest", "weak_impression", "innovative",
    "boring", "overwhelmed", "made_me_think", "share_learning", "learn_more",
)
ANSWER_LABELS = {
    "prior_visit": {"yes": "Yes", "no": "No", "once": "Yes, once", "multiple": "Yes, several times",
                    "several": "Yes, several times", "unknown": "Don't know"},
    "other_camp_connection": YES_NO,
    "ww2_connection": YES_NO,
    "religious": YES_NO,
    "political_identity": {"1": "Left", "2": "Left of center", "3": "Center", "4": "Right of center",
                           "5": "Right"},
    "activities_before": {"start_here": "Started the visit here", "exhibition": "Visited the exhibition",
                          "museum": "Visited the museum", "camp_terrain": "Visited the camp terrain"},
    "education": {"primary": "Primary school", "high_school": "High school",
                  "vocational": "Vocational (MBO)", "bachelor": "Bachelor (HBO/WO)",
                  "master": "Master or higher", "other": "Other"},
    "visit_context": {"alone": "Alone", "partner": "With partner", "family": "With family",
                      "teen_parent": "As a teen with parent(s)", "child_parent": "As a child with parent(s)",
                      "friends": "With friends", "group": "With a group", "school": "School visit"},
    "visit_purpose": {"learn_history": "Learn about the history", "commemoration": "Commemoration",
                      "family_history": "Family history", "school": "School / study",
                      "passing_by": "Passing by", "other": "Other"},
    "relevance": {"past": "The past", "present": "The present", "future": "The future"},
}
FEEDBACK_QUESTIONS = (
    "learned_something", "what_learned", "interest", "weak_impression", "innovative", "boring",
    "overwhelmed", "made_me_think", "memorable", "share_learning", "learn_more", "meaning_today",
    "relevance",
)
ZERO_WIDTH_SPACE = "\u200b"
# ---------------------------------------------------------------------------------------


def sql_map(mapping: dict[str, str]) -> str:
    return "map(" + ", ".join(sql_text(x) for pair in mapping.items() for x in pair) + ")"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '(?U)^\\s+|\\s+$', '')"


def clean_answer(value: str) -> str:
    """Answer entity ids (``a:<question>:value``) reduce to the value."""
    return f"regexp_replace({value}, '^a:[^:]*:', '')"


def answer_values(answers: str, question: tuple[str, ...]) -> str:
    """Cleaned values of the first question id that is present, else an empty array."""
    first = ", ".join(f"{answers}[{sql_text(q)}]" for q in question)
    return f"transform(coalesce({first}, CAST(array() AS ARRAY<STRING>)), v -> {clean_answer('v')})"


def _weighted(prefix: str, labels: str, weight: float) -> str:
    return (
        f"transform(filter({labels}, y -> y IS NOT NULL), "
        f"y -> named_struct('key', concat({sql_text(prefix)}, y), 'weight', {weight}D))"
    )


def canonical_label(value: str) -> str:
    """Separators to spaces, then the fixed spelling aliases."""
    spaced = rf"trim(regexp_replace({value}, '[\\s_\\-]+', ' '))"
    return f"coalesce({sql_map(PREFERENCE_ALIASES)}[lower({spaced})], {spaced})"


def _country(value: str) -> str:
    raw = f"replace(lower({_strip(value)}), ' ', '_')"
    return f"coalesce({sql_map(DEMONYM_COUNTRY)}[{raw}], initcap(replace({value}, '_', ' ')))"


def survey_affinity(answers: str) -> str:
    """array<struct<key,weight>>: one entry per tag the answers of one event give."""

    def mapped(field: str, expression: str) -> str:
        return f"transform({answer_values(answers, QUESTIONS[field])}, w -> {expression})"

    countries = mapped("nationality", _country("w"))
    foreign = (
        f"transform(filter({countries}, c -> lower({_strip('c')}) NOT IN ({sql_list(CORE_COUNTRIES)})), "
        "c -> 'International')"
    )
    province = f"transform(filter({answer_values(answers, QUESTIONS['province'])}, p -> p <> ''), p -> {_strip('p')})"
    parts = [
        _weighted("person_who.age_group:", mapped("age", f"{sql_map(AGE_LABELS)}[w]"), 0.5),
        _weighted("person_who.gender_and_age:", mapped("gender", f"{sql_map(GENDER_LABELS)}[w]"), 0.3),
        _weighted("person_who.city_village_country:From: ", countries, 0.4),
        _weighted("person_who.city_village_country:", foreign, 0.3),
        _weighted("person_who.province_netherlands:", province, 0.5),
    ]
    for question, facet in PERSONALIZATION.items():
        if facet == AREA_FACET:
            continue
        picks = (
            f"filter({answer_values(answers, (question,))}, p -> p <> '' AND NOT {_strip('p')} RLIKE '^[0-9]+$')"
        )
        parts.append(_weighted(f"{facet}:", f"transform({picks}, p -> {canonical_label('p')})", 1.0))
    return f"array_distinct(concat({', '.join(parts)}))"


def email_flag(answers: str) -> str:
    """yes/no only: the address itself never leaves the raw event."""
    key = f"get(filter(map_keys({answers}), e -> contains(lower(e), 'email')), 0)"
    text = f"lower({_strip(f'coalesce({clean_answer(f"get({answers}[{key}], 0)")}, {sql_text("")})')})"
    return f"CASE WHEN {key} IS NULL THEN NULL WHEN contains({text}, '@') OR {text} IN ('yes', 'ja', 'true') THEN 'yes' ELSE 'no' END"


def demographics_of(answers: str) -> str:
    """struct of the demographic fields one event answers (null where it does not)."""
    fields = [f"'{f}', get({answer_values(answers, q)}, 0)" for f, q in QUESTIONS.items()]
    return f"named_struct({', '.join(fields)}, 'email_shared', {email_flag(answers)})"


def demographic_affinity(age: str, gender: str, nationality: str, province: str) -> str:
    """array<struct<key,weight>> from explicit demographics; only numeric ages have a bucket."""

    def entry(prefix: str, label: str, weight: float) -> str:
        return f"IF({label} <> '', named_struct('key', concat('{prefix}', {label}), 'weight', {weight}D), NULL)"

    def capitalized(c: str) -> str:
        return f"concat(upper(substring({c}, 1, 1)), lower(substring({c}, 2)))"

    entries = [
        entry("person_who.age_group:", age_bucket(f"try_cast({age} AS DOUBLE)"), 0.5),
        entry("person_who.gender_and_age:", capitalized(gender), 0.3),
        entry("person_who.city_village_country:From: ", capitalized(nationality), 0.4),
        entry("person_who.province_netherlands:", _strip(province), 0.5),
    ]
    return f"array_compact(array({', '.join(entries)}))"


def canon_demo_value(field: str, value: str) -> str:
    """One token per answer meaning; null for placeholder junk (``no_answer`` for gender)."""
    v = f"rtrim('.', lower({_strip(f'coalesce({value}, {sql_text("")})')}))"
    v = f"translate({v}, '\\'’', '')"
    v = rf"trim(BOTH '_' FROM regexp_replace({v}, '(?U)[\\s\\-.]+', '_'))"
    flat = {f"{f}:{k}": c for f, m in DEMO_CANON.items() for k, c in m.items()}
    out = f"coalesce({sql_map(flat)}[concat({field}, ':', {v})], {v})"
    return (
        f"CASE WHEN {v} IN ('', {sql_list(DEMO_JUNK)}) OR NOT {v} RLIKE '[a-z0-9]' "
        f"THEN IF({field} = 'gender', 'no_answer', NULL) "
        f"WHEN {field} = 'gender' AND {out} NOT IN ({sql_list(GENDER_CANONICAL)}) THEN 'other' ELSE {out} END"
    )


def demo_label(field: str, value: str) -> str:
    return (
        f"CASE WHEN {field} = 'age' AND startswith({value}, 'under_') THEN concat('<', regexp_replace({value}, '[^0-9]', '')) "
        f"WHEN {field} = 'age' THEN replace(replace({value}, '_plus', '+'), '_', '–') "
        f"ELSE initcap(trim(replace({value}, '_', ' '))) END"
    )


def section_of(base: str) -> str:
    demo = sorted({q.removeprefix("q:") for ids in QUESTIONS.values() for q in ids})
    pers = sorted({q.removeprefix("q:") for q in PERSONALIZATION})
    return (
        f"CASE WHEN {base} IN ({sql_list(demo)}) THEN 'demographic' "
        f"WHEN {base} IN ({sql_list(pers)}) OR startswith({base}, 'personalization_') THEN 'personalization' "
        f"WHEN {base} IN ({sql_list(FEEDBACK_QUESTIONS)}) THEN 'feedback' ELSE 'background' END"
    )


def answer_label(base: str, value: str) -> str:
    """Display label of a canonical answer code; unknown codes pass through."""
    flat = {f"{q}:{k}": lbl for q, m in ANSWER_LABELS.items() for k, lbl in m.items()}
    flat |= {f"{q}:{k}": lbl for q in LIKERT_QUESTIONS for k, lbl in LIKERT.items()}
    codes = sql_map(flat)
    return f"coalesce({codes}[concat({base}, ':', {value})], {codes}[concat({base}, ':', lower({value}))], {value})"


def latest_answers(events: DataFrame) -> DataFrame:
    """(user_id, question, answer array): the latest non-empty answer per raw question id."""
    answers = events.selectExpr("user_id", "ts", "event_id", "explode(survey_answers) AS (question, answer)")
    return (
        answers.filter("answer IS NOT NULL AND concat_ws('', answer) <> ''")
        .groupBy("user_id", "question")
        .agg(F.expr("max_by(answer, struct(ts, event_id)) AS answer"))
    )


def split_answers(events: DataFrame) -> DataFrame:
    """Long survey profile: one row per (user, base question), grouped into four sections.

    A question arrives under ``q:<base>`` and ``<base>``; the plain key wins. E-mail
    answers are dropped. ``score`` is set for single Likert answers.
    """
    stripped = _strip(f"translate(v, '{ZERO_WIDTH_SPACE}', '')")
    cleaned = latest_answers(events).selectExpr(
        "user_id", "startswith(question, 'q:') AS is_q", "regexp_replace(question, '^q:', '') AS base",
        f"filter(transform(answer, v -> {stripped}), v -> v <> '') AS answer",
    ).filter("size(answer) > 0 AND NOT contains(lower(base), 'email')")
    one = (
        cleaned.groupBy("user_id", "base")
        .agg(F.expr("min_by(answer, is_q) AS answer"))
        .selectExpr("*", f"{section_of('base')} AS section")
    )
    labelled = "section IN ('feedback', 'background')"
    likert = f"{labelled} AND base IN ({sql_list(LIKERT_QUESTIONS)}) AND size(answer) = 1 AND answer[0] RLIKE '^[0-9]+$'"
    return one.selectExpr(
        "user_id", "section", "base", "answer",
        f"IF({labelled}, transform(answer, v -> {answer_label('base', 'v')}), answer) AS labels",
        f"IF({likert}, try_cast(answer[0] AS INT), NULL) AS score",
        f"IF({likert} AND try_cast(answer[0] AS INT) IS NOT NULL, 5, NULL) AS scale",
    )


def feedback_scores(events: DataFrame) -> DataFrame:
    """(user_id, question, score) of the post-visit Likert questions."""
    return (
        split_answers(events)
        .filter("section = 'feedback' AND score IS NOT NULL")
        .selectExpr("user_id", "base AS question", "score")
    )
