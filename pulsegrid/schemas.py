"""Declared input schemas; a column the files lack is read as a typed null."""

from __future__ import annotations

STATUS_CODES = ["Alarm", "3", "4", "4b", "7", "8", "8b", "1", "2", "End"]

VITAL_CODES = ["af", "bd", "bz", "co", "co2", "hb", "hf", "puls", "spo2", "temp"]

_STATUS_FIELDS = ", ".join(f"dateStatus{c}: STRING, timeStatus{c}: STRING" for c in STATUS_CODES)

INDEX = (
    "protocolId STRING, missionNumber STRING, missionDate TIMESTAMP_NTZ, "
    "createdAt TIMESTAMP_NTZ, updatedAt TIMESTAMP_NTZ, alarmTime TIMESTAMP_NTZ, "
    "missionType STRING, staticMissionType STRING, statisticMissionType STRING, "
    "emergencyCareType STRING, leadingDiagnosis STRING, targetDestination STRING, "
    "patientCity STRING, patientStreet STRING, patientHouseNumber STRING, "
    "callSign STRING, evmCount INT"
)

DETAILS = (
    f"protocolId STRING, content STRUCT<{_STATUS_FIELDS}, flashingLights: STRING, "
    "transportFlashingLights: STRING, nachforderungNA: STRING>"
)

FINDINGS = (
    "_id STRING, protocolId STRING, source STRING, data ARRAY<STRUCT<description: STRING, "
    "valueInteger: STRING, valueString: STRING, type: STRING, "
    "timeStamp: TIMESTAMP_NTZ, source: STRING>>"
)

RESULTS = (
    "_id STRING, protocolId STRING, source STRING, data ARRAY<STRUCT<value_1: STRING, "
    "value_2: STRING, timeStamp: TIMESTAMP_NTZ, source: STRING>>"
)

MEASURES = (
    "_id STRING, protocolId STRING, source STRING, data ARRAY<STRUCT<value_1: STRING, "
    "value_2: STRING, value_3: STRING, value_4: STRING, value_5: STRING, value_6: STRING, "
    "value_7: STRING, value_8: STRING, value_10: STRING, value_11: STRING, "
    "timeStamp: TIMESTAMP_NTZ, source: STRING>>"
)

FREETEXTS = (
    "_id STRING, protocolId STRING, data ARRAY<STRUCT<protocolId: STRING, description: STRING, "
    "content: STRING, text: STRING, value: STRING, data: STRING, comment: STRING>>"
)

# One schema for both shapes a vitals file may have: items nested in ``data``
# or the same fields flat on the document.
VITALS = (
    "protocolId STRING, data ARRAY<STRUCT<value: DOUBLE, unit: STRING, `%`: STRING, "
    "o2Administration: STRING, description: STRING, timeStamp: TIMESTAMP_NTZ, source: STRING>>, "
    "value DOUBLE, unit STRING, `%` STRING, o2Administration STRING, description STRING, "
    "timeStamp TIMESTAMP_NTZ, source STRING"
)

DISPATCH = (
    "EINSATZ_NR STRING, AUFTRAGS_NR STRING, EO_LANDKREIS STRING, EO_ORT STRING, "
    "EO_STRASSE STRING, EO_STRASSE_ZUSATZ STRING, EO_X_KOORD DOUBLE, EO_Y_KOORD DOUBLE, "
    "EINSATZBEGINN TIMESTAMP_NTZ, EINSATZENDE TIMESTAMP_NTZ, EINSATZDATUM TIMESTAMP_NTZ, "
    "EINSATZMITTEL STRING, CEDUS_CODE STRING, SZENARIO_BEGINN STRING, "
    "SZENARIO_ABSCHLUSS STRING, STATUS_BEI_ALARMIERUNG STRING"
)

HOLIDAYS = "date DATE, name STRING"
SCHEDULE = "vehicle STRING, weekly_hours INT"
ANSWERS = "text_key STRING, answer STRING"

COLLECTIONS = {
    "index": INDEX,
    "details": DETAILS,
    "findings": FINDINGS,
    "results": RESULTS,
    "measures": MEASURES,
    "freetexts": FREETEXTS,
    "dispatch": DISPATCH,
    "holidays": HOLIDAYS,
    "schedule": SCHEDULE,
    "answers": ANSWERS,
    **{f"vitals_{code}": VITALS for code in VITAL_CODES},
}
