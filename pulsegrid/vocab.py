"""Word lists, labels and templates the results depend on."""

UNKNOWN = "Unbekannt"
OTHER = "Sonstige"

# Mission types that count as primary missions.
PRIMARY_MISSION_TYPES = ["Pauschale RTW", "RTW - Transport"]
PRIMARY_MISSION_TYPES_WITH_DOCTOR = ["Pauschale RTW", "RTW - Transport", "Pauschale NEF"]
MONITORED_MISSION_TYPES = ["RTW-Transport", "Pauschale RTW"]

# Diagnosis terms of the interval cohorts.
COHORT_TERMS = {
    "polytrauma": ["polytrauma"],
    "stemi": ["stemi", "acs"],
    "stroke": ["schlaganfall"],
    "head_injury": ["schädel-hirn"],
    "sepsis": ["sepsis"],
}

# Diagnosis terms of the coverage and destination cohorts.
CHEST_PAIN_TERMS = ["acs", "brustschmerz", "thoraxschmerz", "angina", "herzinfarkt"]
ASPIRIN = "Acetylsalicylsäure"
TRAUMA_TERMS = ["polytrauma", "schwerverletzt"]
CARDIAC_TERMS = ["stemi", "nstemi", "acs", "herzinfarkt", "st-hebung", "sthebung", "akutes koronarsyndrom"]
ARREST_TERMS = ["reanimation", "herz-kreislauf-stillstand", "wiederbelebung"]
STROKE_TERMS = [
    "schlaganfall", "tia", "stroke", "apoplex", "neurologisches defizit",
    "halbseitenlähmung", "hemiplegie", "parese", "sprachstörung",
]

# Capability columns of the hospital table.
CAP_STROKE = "TIA / Schlaganfall"
CAP_CARDIAC = "ACS / STEMI /NSTEMI"
CAP_ARREST = "Reanimation"
CAP_TRAUMA = "Polytrauma"
CAPABILITIES = [CAP_STROKE, CAP_CARDIAC, CAP_ARREST, CAP_TRAUMA]

# Diagnosis keyword to capability, first hit wins.
TRAUMA_KEYWORDS = [
    ("schlaganfall", CAP_STROKE), ("tia", CAP_STROKE),
    ("stemi", CAP_CARDIAC), ("nstemi", CAP_CARDIAC), ("acs", CAP_CARDIAC), ("herzinfarkt", CAP_CARDIAC),
    ("reanimation", CAP_ARREST), ("Herz-Kreislauf-Stillstand", CAP_ARREST),
    ("polytrauma", CAP_TRAUMA), ("schwerverletzt", CAP_TRAUMA),
]
CARDIAC_KEYWORDS = [
    ("schlaganfall", CAP_STROKE), ("tia", CAP_STROKE),
    ("stemi", CAP_CARDIAC), ("nstemi", CAP_CARDIAC), ("acs", CAP_CARDIAC), ("herzinfarkt", CAP_CARDIAC),
    ("st-hebung", CAP_CARDIAC), ("sthebung", CAP_CARDIAC),
    ("reanimation", CAP_ARREST), ("Herz-Kreislauf-Stillstand", CAP_ARREST),
    ("polytrauma", CAP_TRAUMA), ("schwerverletzt", CAP_TRAUMA),
]
STROKE_KEYWORDS = [
    ("schlaganfall", CAP_STROKE), ("tia", CAP_STROKE), ("stroke", CAP_STROKE), ("apoplex", CAP_STROKE),
    ("neurologisches defizit", CAP_STROKE), ("halbseitenlähmung", CAP_STROKE),
    ("hemiplegie", CAP_STROKE), ("parese", CAP_STROKE), ("sprachstörung", CAP_STROKE),
    ("stemi", CAP_CARDIAC), ("nstemi", CAP_CARDIAC), ("acs", CAP_CARDIAC), ("herzinfarkt", CAP_CARDIAC),
    ("reanimation", CAP_ARREST), ("Herz-Kreislauf-Stillstand", CAP_ARREST),
    ("polytrauma", CAP_TRAUMA), ("schwerverletzt", CAP_TRAUMA),
]

# Item names in the nested documents.
ITEM_SCORE = "GCS"
ITEM_PAIN = "Schmerzen"
ITEM_NEURO = "Auffälligkeiten"
ITEM_PUPIL_LEFT = "Lichtreaktion links"
ITEM_PUPIL_RIGHT = "Lichtreaktion rechts"
ITEM_TRIAGE = "NACA"
ITEM_ONSET = "Symptombeginn"
ITEM_ONSET_SPEC = "Spezifikation Symptombeginn"
ITEM_RESUSCITATION = "Rea durchgeführt"
ITEM_MEDICATION = "Medikamente"
ITEM_AIRWAY = "Atemweg"
ITEM_INTUBATION = "Intubation"
ITEM_MONITORING = "Monitoring"
ITEM_ECG = "12-Kanal-EKG"
ITEM_EXTENDED = "EVM"
ITEM_ANAMNESIS = "Anamnese"

FIRST_FINDING = "eb_neuro"
HANDOVER_FINDING = "ue_neuro"

DISTRICT = "Schleswig-Flensburg"

# Mission categories of the patient-transport table.
MISSION_CATEGORIES = ["S-KTW – Transport", "S-KTW – Kein Transport", "Andere S-KTW"]

# Vehicle classes in legend order, and the terms of the weekly chart's groups.
VEHICLE_CLASSES = ["nef", "rtw", "s-ktw", "ktw", "other"]
TRANSPORT_BUCKETS = [("nef", ["nef"]), ("rtw", ["rtw"]), ("s-ktw", ["s-ktw"]), ("ktw", ["ktw"])]
NO_TRANSPORT_BUCKETS = [("nef", ["nef"]), ("ktw", ["ktw"]), ("rtw", ["rtw"])]

# Vehicle status texts at alarm time.
STATUS_ON_RADIO = "1 Einsatzbereit Funk"
STATUS_AT_STATION = "2 Einsatzbereit Wache"

# Phrases of the case-sensitive requirement classifier.
BASIC_REQUIREMENT_RULES = {
    "medical_care": [
        ("needed", [
            "Während des Transport wurde eine medizinische Betreuung notwendig. Es wurden folgende Maßnahmen ergriffen:",
        ]),
        ("not_needed", [
            "Während des gesamten Transports ist keine medizinische Betreuung notwendig geworden.",
        ]),
    ],
    "ktw_equipment": [
        ("needed", [
            "Während der Fahrt war der Patient auf die folgende besondere Ausstattung eines KTW angewiesen:",
        ]),
        ("not_needed", [
            "Während der Fahrt war der Patient zu keiner Zeit auf die besondere Ausstattung eines KTW angewiesen",
        ]),
    ],
    "infectious_disease": [
        ("needed", [
            "Bei dem Patient liegt eine schwere ansteckende Infektionserkrankung vor, sodass lokale Schutzmaßnahmen während des Transportes nicht ausreichen",
        ]),
        ("not_needed", [
            "Bei dem Patienten ist keine schwere ansteckende Infektionserkrankung festgestellt worden oder als wahrscheinlich anzunehmen.",
        ]),
        ("local_protection", [
            "Bei dem Patienten liegt eine Infektionserkrankung vor, deren Verbreitung jedoch durch lokal Schutzmaßnahmen ausreichend vermieden werden kann",
        ]),
    ],
}

# Phrases of the requirement classifier on lower-cased text,
# groups in the order in which they decide.
REQUIREMENT_RULES = {
    "medical_care": [
        ("nicht_indiziert", ["keine medizinische betreuung notwendig geworden"]),
        ("indiziert", [
            "medizinische betreuung notwendig",
            "medizinische versorgung erforderlich",
            "ärztliche betreuung notwendig",
            "medizinische intervention",
            "während des transport wurde eine medizinische betreuung notwendig",
        ]),
        ("logistische_soziale_paedagogische", [
            "logistische betreuung",
            "soziale betreuung",
            "pädagogische betreuung",
            "psychologische betreuung",
            "begleitperson notwendig",
            "keine medizinische betreuung notwendig geworden, sondern lediglich eine logistische",
        ]),
    ],
    "ktw_equipment": [
        ("nicht_indiziert", [
            "keine besondere ausstattung ktw",
            "keine spezielle ausstattung ktw",
            "während der fahrt war der patient zu keiner zeit auf die besondere ausstattung eines ktw angewiesen",
        ]),
        ("krankenfahrt", [
            "krankenfahrt ausreichend",
            "beförderung als krankenfahrt ausreichend",
            "keine besondere ausstattung eines ktw erforderlich, sodass die beforderung als krankenfahrt ausreichend",
            "lediglich liegend transportiert werden",
            "lediglich im rollstuhl sitzend transportiert werden",
            "der patient muss lediglich liegend / im rollstuhl sitzend transportiert werden",
        ]),
        ("indiziert", [
            "besondere ausstattung ktw",
            "spezielle ausstattung ktw",
            "rtw ausstattung notwendig",
            "intensivtransport",
            "beatmung notwendig",
            "monitorüberwachung",
            "defibrillator notwendig",
            "während der fahrt war der patient auf die folgende besondere ausstattung eines ktw angewiesen",
        ]),
    ],
    "infectious_disease": [
        ("nicht_indiziert", [
            "keine ansteckende infektionserkrankung",
            "nicht infektiös",
            "keine isolierung notwendig",
            "bei dem patienten ist keine schwere ansteckende infektionserkrankung festgestellt worden oder als wahrscheinlich anzunehmen",
        ]),
        ("lokaler_schutz", [
            "lokale schutzmaßnahmen ausreichend",
            "standard hygiene ausreichend",
            "normale schutzmaßnahmen",
            "bei dem patienten liegt eine infektionserkrankung vor, deren verbreitung jedoch durch lokal schutzmaßnahmen ausreichend vermieden werden kann",
        ]),
        ("indiziert", [
            "schwere ansteckende infektionserkrankung",
            "hochinfektiös",
            "isolierung notwendig",
            "quarantäne",
            "infektionsschutz",
            "bei dem patient liegt eine schwere ansteckende infektionserkrankung vor",
        ]),
    ],
    "crew_assessment": [
        ("krankenfahrt_ausreichend", [
            "laut vorliegendem patientenzustand ist eine beförderung des patienten indiziert, jedoch nicht als krankentransport sondern als krankenfahrt",
        ]),
        ("indiziert", [
            "ärztliche begleitung notwendig",
            "die vorliegenden begründungen der transportverordnung bzw. der übergabe entsprechen den einschätzungen des teamleiters",
        ]),
        ("nicht_indiziert", [
            "auch bei genauer anamnese ist keine indikationen für einen krankentransport oder eine krankenfahrt erkennbar",
        ]),
    ],
}
MENTION_RULE = ("krankenfahrt_mentioned", "krankenfahrt")

# Display labels of the requirement codes.
NO_ENTRY_LABEL = "keine Angaben"
REQUIREMENT_LABELS = {
    "indiziert": "indiziert",
    "nicht_indiziert": "nicht indiziert",
    "logistische_soziale_paedagogische": "logistisch/sozial/pädagogisch",
    "krankenfahrt": "Krankenfahrt",
    "lokaler_schutz": "lokaler Schutz",
    "krankenfahrt_ausreichend": "Krankenfahrt ausreichend",
}

# Keys of a structured answer and the field each one fills.
ANSWER_FIELDS = {
    "UEBERGRIF_VORHANDEN": "übergriff_vorhanden",
    "UEBERGRIF_ART": "übergriff_art",
    "UEBERGRIF_TEXTBELEG": "übergriff_textbeleg",
    "VERWEIGERUNG_VORHANDEN": "verweigerung_vorhanden",
    "VERWEIGERUNG_MASSNAHME": "verweigerung_massnahme",
    "VERWEIGERUNG_BEGRUENDUNG": "verweigerung_begruendung",
    "HILFEBEDARF_TYP": "hilfebedarf_typ",
    "HILFEBEDARF_BESCHREIBUNG": "hilfebedarf_beschreibung",
    "MEDIZINISCHES_PROBLEM_BESCHREIBUNG": "medizinisches_problem_beschreibung",
    "MEDIZINISCHES_PROBLEM_KATEGORIE": "medizinisches_problem_kategorie",
    "AUFFAELLIGKEITEN_VORHANDEN": "auffaelligkeiten_vorhanden",
    "AUFFAELLIGKEITEN_BESCHREIBUNG": "auffaelligkeiten_beschreibung",
}

# Answer fields of the yes/no summary.
ANSWER_CATEGORIES = {
    "Übergriffe": "übergriff_vorhanden",
    "Verweigerungen": "verweigerung_vorhanden",
    "Auffälligkeiten": "auffaelligkeiten_vorhanden",
}

# The request text; {text} stands for the anamnesis.
PROMPT = """
        Analysiere diesen Anamnesetext und gib eine strukturierte Analyse zurück.

        TEXT: {text}

        Gib deine Antwort als einfache Textzeilen mit diesem Format:

        Erklärung: Wurde in dem Anamnesetext ein Übergriff auf Einsatzkräfte beschrieben?
        UEBERGRIF_VORHANDEN: [ja/nein]
        UEBERGRIF_ART: [verbal/koerperlich/sexuell/keine]
        UEBERGRIF_TEXTBELEG: [konkreter Text aus dem Anamnesetext oder "kein"]

        Erklärung: Wurden Maßnahmen, Untersuchungen oder Transport verweigert?
        VERWEIGERUNG_VORHANDEN: [ja/nein]
        VERWEIGERUNG_MASSNAHME: [konkrete abgelehnte Maßnahme oder "keine"]
        VERWEIGERUNG_BEGRUENDUNG: [konkreter Grund oder "kein"]

        Erklärung: Welche maßnahmen wurden durchgeführt?
        HILFEBEDARF_TYP: [medizinisch/pflegerisch/aufstehhilfe/unbekannt]
        HILFEBEDARF_BESCHREIBUNG: [kurze Beschreibung oder "keine"]

        Erklärung: Liegt ein akutes Rettungsdienstliches Problem vor? (keine chronischen Krankheiten)
        MEDIZINISCHES_PROBLEM_BESCHREIBUNG: [konkrete Beschreibung oder "kein Problem"]
        MEDIZINISCHES_PROBLEM_KATEGORIE: [kardiovaskulär/respiratorisch/neurologisch/traumatologisch/intoxikation/psychisch/sonstiges/keine]

        Erklärung: Wurden sonstige Einsatzbesonderheiten beschrieben?
        AUFFAELLIGKEITEN_VORHANDEN: [ja/nein]
        AUFFAELLIGKEITEN_BESCHREIBUNG: [konkrete Beschreibung oder "keine"]

        WICHTIG: Verwende nur die erlaubten Werte in Klammern. Gib keine zusätzlichen Erklärungen.
        """

# Airway devices that allow capnography, and drugs for an emergency anaesthetic.
CAPNOGRAPHY_DEVICES = ["Endotrachealtubus", "Larynxmaske", "Larynxtubus"]
ANAESTHETICS = ["Propofol", "Midazolam", "Trapanal", "S - Ketamin", "Fentanyl", "Rocuronium", "Succinycholin"]
