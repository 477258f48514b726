"""Requirement classification and structured extraction over whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchset import views as v
from benchset.registry import query, rounded
from pulsegrid import vocab
from pulsegrid.functions import clean
from pulsegrid.plans import anamnesis, linkage, requirements

W = v.with_ctes


def _sql_label(text: str, rules) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + f" THEN '{label}'"
        for label, phrases in rules
    )
    return f"CASE {whens} END"


def _sql_labels(text: str, rules) -> str:
    return ", ".join(f"{_sql_label(text, groups)} AS {name}" for name, groups in rules.items())


# Classifier results on the derived anamnesis texts.
SQL_LABELS = f"""lab AS (SELECT protocolId, {_sql_labels('lower(content)', vocab.REQUIREMENT_RULES)},
    contains(lower(content), 'krankenfahrt') AS krankenfahrt_mentioned FROM txt)"""


@query(
    "requirement_labels",
    W(v.SQL_TEXTS, SQL_LABELS)
    + """SELECT protocolId, medical_care, ktw_equipment, infectious_disease, crew_assessment, krankenfahrt_mentioned FROM lab""",
)
def requirement_labels(spark, sf):
    rows = requirements.classify_texts(requirements.anamnesis_texts(v.freetexts(spark, sf)))
    return rows.select(
        "protocolId", "medical_care", "ktw_equipment", "infectious_disease", "crew_assessment", "krankenfahrt_mentioned"
    )


# The same classifier with other phrase lists, over the document texts as they are.
PROSE_RULES = {
    "topic": [("negated", ["not ", "nicht "]), ("joined", ["und ", "and ", " et "]), ("article", ["der ", "the ", "le "])],
    "opening": [("question", ["?"]), ("list", ["- ", "* "]), ("markup", ["<", "http"])],
}


@query(
    "requirement_labels_prose",
    f"""SELECT doc_id, {_sql_labels('lower(text)', PROSE_RULES)}, contains(lower(text), 'license') AS licensed FROM documents""",
)
def requirement_labels_prose(spark, sf):
    documents = v.table(spark, sf, "documents")
    rows = requirements.classify_texts(documents, "text", PROSE_RULES, ("licensed", "license"))
    return rows.select("doc_id", "topic", "opening", "licensed")


# Sentences of the case-sensitive classifier, one per document.
BASIC = [p for rules in vocab.BASIC_REQUIREMENT_RULES.values() for _, phrases in rules for p in phrases]
BASIC_TEXT = (
    "text || CASE doc_id % 9 "
    + " ".join(f"WHEN {i} THEN ' {p}'" for i, p in enumerate(BASIC))
    + " WHEN 7 THEN ' "
    + BASIC[0].upper()
    + "' ELSE '' END"
)


@query(
    "requirement_labels_basic",
    f"""WITH t AS (SELECT doc_id, {BASIC_TEXT} AS content FROM documents)
    SELECT doc_id, {_sql_labels('content', vocab.BASIC_REQUIREMENT_RULES)} FROM t""",
)
def requirement_labels_basic(spark, sf):
    rows = v.table(spark, sf, "documents").select("doc_id", F.expr(BASIC_TEXT).alias("content"))
    return requirements.classify_texts_basic(rows).drop("content")


def ktw_labels(spark, sf):
    missions = requirements.plain_transports(v.index(spark, sf))
    return requirements.classify_texts(requirements.anamnesis_texts(v.freetexts(spark, sf), missions))


SQL_KTW = """ktw AS (SELECT lab.* FROM lab WHERE protocolId IN (SELECT protocolId FROM idx
    WHERE missionType IN ('KTW', 'KTW - kein Transport')))"""
_FIELDS = [*vocab.REQUIREMENT_RULES]


@query(
    "requirement_summary",
    W(v.SQL_INDEX, v.SQL_TEXTS, SQL_LABELS, SQL_KTW)
    + """SELECT 'texts' AS measure, CAST(count(*) AS DOUBLE) AS value FROM ktw
    UNION ALL SELECT 'undocumented', count(*) FILTER (WHERE medical_care IS NULL AND ktw_equipment IS NULL AND infectious_disease IS NULL) FROM ktw
    UNION ALL SELECT 'undocumented_percent', round(count(*) FILTER (WHERE medical_care IS NULL AND ktw_equipment IS NULL
        AND infectious_disease IS NULL) * 100.0 / count(*), 6) FROM ktw
    UNION ALL SELECT 'rate medical_care', round(count(medical_care) * 100.0 / count(*), 6) FROM ktw
    UNION ALL SELECT 'rate ktw_equipment', round(count(ktw_equipment) * 100.0 / count(*), 6) FROM ktw
    UNION ALL SELECT 'rate infectious_disease', round(count(infectious_disease) * 100.0 / count(*), 6) FROM ktw
    UNION ALL SELECT 'indicated medical_care', count(*) FILTER (WHERE medical_care = 'indiziert') FROM ktw
    UNION ALL SELECT 'indicated ktw_equipment', count(*) FILTER (WHERE ktw_equipment = 'indiziert') FROM ktw
    UNION ALL SELECT 'indicated infectious_disease', count(*) FILTER (WHERE infectious_disease = 'indiziert') FROM ktw
    UNION ALL SELECT 'needs ' || (CASE WHEN medical_care = 'indiziert' THEN 1 ELSE 0 END + CASE WHEN ktw_equipment = 'indiziert' THEN 1 ELSE 0 END
        + CASE WHEN infectious_disease = 'indiziert' THEN 1 ELSE 0 END), count(*) FROM ktw GROUP BY 1""",
)
def requirement_summary(spark, sf):
    return rounded(requirements.overview(ktw_labels(spark, sf)))


_LABEL_CASE = (
    f"CASE WHEN code IS NULL THEN '{vocab.NO_ENTRY_LABEL}' "
    + " ".join(f"WHEN code = '{c}' THEN '{t}'" for c, t in vocab.REQUIREMENT_LABELS.items())
    + " ELSE code END"
)


@query(
    "requirement_label_counts",
    W(v.SQL_INDEX, v.SQL_TEXTS, SQL_LABELS, SQL_KTW)
    + ", c AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS code, count(*) AS count FROM ktw GROUP BY 2" for f in _FIELDS)
    + f") SELECT field, code, count, {_LABEL_CASE} || ' (' || count || ')' AS label FROM c",
)
def requirement_label_counts(spark, sf):
    return requirements.label_counts(ktw_labels(spark, sf), _FIELDS)


# Whitespace as the library strips it, written for a regular expression.
_SPACE = "".join(f"\\x{{{ord(c):x}}}" for c in clean.WHITESPACE)


def _sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


SQL_PICKED = f"""chosen AS (SELECT protocolId, coalesce(nullif({_sql_strip('other')}, ''), nullif({_sql_strip('content')}, '')) AS text
    FROM txt WHERE description = 'Anamnese'),
picked AS (SELECT protocolId, text, sha256(text) AS text_key FROM chosen WHERE text IS NOT NULL)"""


@query(
    "text_dedupe_fanout",
    W(v.SQL_TEXTS, SQL_PICKED)
    + """, d AS (SELECT text_key, count(*) AS copies, min(protocolId) AS first_protocol FROM picked GROUP BY 1)
    SELECT protocolId, text_key, copies, first_protocol, text FROM picked JOIN d USING (text_key)""",
)
def text_dedupe_fanout(spark, sf):
    texts = anamnesis.protocol_texts(v.freetexts(spark, sf))
    distinct = anamnesis.distinct_texts(texts).select(
        "text_key", "copies", F.col("protocolId").alias("first_protocol")
    )
    return texts.join(distinct, "text_key").select(
        "protocolId", "text_key", "copies", "first_protocol", "text"
    )


_HEAD, _TAIL = (part.replace("'", "''") for part in vocab.PROMPT.split("{text}"))


@query(
    "prompt_table",
    W(v.SQL_TEXTS, SQL_PICKED)
    + f"""SELECT text_key, min(protocolId) AS protocolId, sha256('{_HEAD}' || any_value(text) || '{_TAIL}') AS prompt_sha
    FROM picked GROUP BY text_key""",
)
def prompt_table(spark, sf):
    prompts = anamnesis.prompts(anamnesis.protocol_texts(v.freetexts(spark, sf)))
    return prompts.select("text_key", "protocolId", F.sha2("prompt", 256).alias("prompt_sha"))


# Answer texts composed from the whole documents, as one line: fenced and bare, bracketed values,
# repeated keys, list markers, text with further colons.
_ASSAULT = "CASE doc_id % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'nein' ELSE 'unklar' END"
_REFUSAL = "CASE doc_id % 4 WHEN 0 THEN 'ja' ELSE 'nein' END"
_HELP = "CASE doc_id % 5 WHEN 0 THEN 'medizinisch' WHEN 1 THEN 'Medizinisch und pflegerisch' ELSE 'pflegerisch' END"


def _answer(newline: str, one_line: str) -> str:
    body = (
        f"'UEBERGRIF_VORHANDEN: vielleicht' || {newline} || 'uebergrif_vorhanden : [' || {_ASSAULT} || ']' || {newline} || "
        f"'UEBERGRIF_ART: - verbal' || {newline} || 'kein Schluessel' || {newline} || "
        f"'VERWEIGERUNG_VORHANDEN:' || {_REFUSAL} || {newline} || 'VERWEIGERUNG_MASSNAHME: **keine**' || {newline} || "
        f"'HILFEBEDARF_TYP:  ' || {_HELP} || '  ' || {newline} || "
        f"'MEDIZINISCHES_PROBLEM_KATEGORIE: Zeit: ' || lang || ': ' || source || {newline} || "
        f"'AUFFAELLIGKEITEN_BESCHREIBUNG: [' || {one_line} || ']'"
    )
    fence = f"'```' || {newline}"
    return (
        f"CASE WHEN doc_id % 2 = 0 THEN '  ' || {fence} || {body} || {newline} || '```' || {newline} || "
        f"'HILFEBEDARF_TYP: aufstehhilfe' ELSE {body} END"
    )


def answers(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", F.expr(_answer("'\\n'", "translate(text, '\\n', ' ')")).alias("answer")
    )


SQL_ANSWERS = f"""ans AS (SELECT doc_id, {_ASSAULT} AS "übergriff_vorhanden", '' AS "übergriff_art", '' AS "übergriff_textbeleg",
    {_REFUSAL} AS verweigerung_vorhanden, '' AS verweigerung_massnahme, '' AS verweigerung_begruendung,
    {_HELP} AS hilfebedarf_typ, '' AS hilfebedarf_beschreibung, '' AS medizinisches_problem_beschreibung,
    'Zeit: ' || lang || ': ' || source AS medizinisches_problem_kategorie, '' AS auffaelligkeiten_vorhanden,
    {_sql_strip("replace(text, chr(10), ' ')")} AS line FROM documents),
par AS (SELECT * EXCLUDE (line), CASE WHEN line LIKE '- %' OR line LIKE '**%' THEN '' ELSE line END
    AS auffaelligkeiten_beschreibung FROM ans)"""


@query("answer_parse", W(SQL_ANSWERS) + "SELECT * FROM par")
def answer_parse(spark, sf):
    return anamnesis.parse_answers(answers(spark, sf))


@query(
    "answer_summary",
    W(SQL_ANSWERS)
    + """, n AS (SELECT count(*) AS n FROM par),
    c AS (SELECT 'Übergriffe' AS category, "übergriff_vorhanden" AS x FROM par UNION ALL SELECT 'Verweigerungen', verweigerung_vorhanden FROM par
        UNION ALL SELECT 'Auffälligkeiten', auffaelligkeiten_vorhanden FROM par)
    SELECT category, count(*) FILTER (WHERE x = 'ja') AS yes, count(*) FILTER (WHERE x = 'nein') AS no,
    count(*) FILTER (WHERE x IN ('ja', 'nein')) AS total,
    round(count(*) FILTER (WHERE x = 'ja') * 100.0 / any_value(n), 6) AS percent FROM c CROSS JOIN n GROUP BY 1""",
)
def answer_summary(spark, sf):
    return rounded(anamnesis.yes_no_summary(anamnesis.parse_answers(answers(spark, sf))))


@query(
    "answer_case_counts",
    W(SQL_ANSWERS)
    + """SELECT count(*) AS cases, count(*) FILTER (WHERE "übergriff_vorhanden" LIKE '%ja%') AS assaults,
    count(*) FILTER (WHERE lower(hilfebedarf_typ) LIKE '%medizinisch%') AS medical_help,
    count(*) FILTER (WHERE verweigerung_vorhanden LIKE '%ja%') AS refusals FROM par""",
)
def answer_case_counts(spark, sf):
    return anamnesis.case_counts(anamnesis.parse_answers(answers(spark, sf)))


@query(
    "answer_field_counts",
    W(SQL_ANSWERS) + "SELECT medizinisches_problem_kategorie, count(*) AS count FROM par GROUP BY 1",
)
def answer_field_counts(spark, sf):
    parsed = anamnesis.parse_answers(answers(spark, sf))
    return anamnesis.field_counts(parsed, "medizinisches_problem_kategorie")


@query(
    "answer_fan_out",
    W(v.SQL_INDEX, v.SQL_DISPATCH, v.SQL_TEXTS, SQL_PICKED)
    + f""", linked AS (SELECT DISTINCT idx.protocolId FROM dsp JOIN idx ON EINSATZ_NR = missionNumber),
    mine AS (SELECT * FROM picked WHERE protocolId IN (SELECT protocolId FROM linked)),
    d AS (SELECT text_key, min(protocolId) AS p FROM mine GROUP BY 1)
    SELECT protocolId AS einsatz_id, text AS anamnesis_text,
    CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS anamnesis_preview,
    CASE WHEN CAST(p AS BIGINT) % 2 = 0 THEN 'ja' ELSE 'nein' END AS "übergriff_vorhanden", 'Text ' || text_key AS hilfebedarf_beschreibung
    FROM mine JOIN d USING (text_key)""",
)
def answer_fan_out(spark, sf):
    """Linked protocols, one prompt per distinct text, answers fanned out by the whole text."""
    linked = linkage.link_protocols(v.dispatch(spark, sf), v.index(spark, sf)).where(F.col("protocolId").isNotNull())
    texts = anamnesis.protocol_texts(v.freetexts(spark, sf), linked)
    asked = anamnesis.prompts(texts)
    answer = F.expr(
        "'UEBERGRIF_VORHANDEN: ' || CASE WHEN CAST(protocolId AS BIGINT) % 2 = 0 THEN 'ja' ELSE 'nein' END || '\\n' || "
        "'HILFEBEDARF_BESCHREIBUNG: Text ' || text_key"
    )
    parsed = anamnesis.parse_answers(asked.select("text_key", answer.alias("answer")))
    fanned = anamnesis.fan_out(texts, parsed)
    return fanned.select("einsatz_id", "anamnesis_text", "anamnesis_preview", "übergriff_vorhanden", "hilfebedarf_beschreibung")
