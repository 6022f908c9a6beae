"""Word lists of the calendar domain. Order is meaning: the first hit wins wherever a list is searched."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

# Results depend on these very strings.

DISTRICT_SUFFIXES = [" in blankenloch", " in büchig", " in friedrichstal", " in spöck", " in staffort", " blankenloch", " büchig", " friedrichstal", " spöck", " staffort"]

CORE_DISTRICTS = ["blankenloch", "büchig", "buechig", "friedrichstal", "spöck", "spoeck", "staffort", "stutensee"]

DISTRICTS = {
    "Blankenloch": ["blankenloch", "bl.", "mehrgenerationenhaus", "bürgerwerkstatt", "seegrabenweg", "gymnasiumstr", "zukunftshaus"],
    "Büchig": ["büchig", "buechig"],
    "Friedrichstal": ["friedrichstal", "spöcker weg", "spoecker weg"],
    "Spöck": ["spöck", "spoeck"],
    "Staffort": ["staffort"],
    "Weingarten": ["weingarten", "weingarten (baden)", "mineralix-arena", "walzbachhalle"],
    "Hagsfeld": ["hagsfeld"],
    "Büchenau": ["büchenau", "buechenau"],
    "Neuthard": ["neuthard", "karlsdorf", "karlsdorf-neuthard", "zehntscheuer"],
    "Waldstadt": ["waldstadt", "bv-waldstadt"],
    "Neureut": ["neureut", "badnerlandhalle", "kunstraum neureut", "neureuter platz", "stadtteilbibliothek neureut"],
    "Eggenstein": ["eggenstein"],
    "Leopoldshafen": ["leopoldshafen"],
    "Rintheim": ["rintheim"],
    "Linkenheim": ["linkenheim", "linkenheim-hochstetten"],
    "Graben-Neudorf": ["graben-neudorf"],
    "Bruchsal": ["bruchsal"],
    "Bretten": ["bretten"],
    "Durlach": ["durlach", "pfinzgaumuseum", "karlsburg", "gemeindezentrum durlach", "st. peter und paul kirche durlach", "stadtbibliothek durlach", "trinitatiskirche durlach-aue"],
    "Karlsruhe-Innenstadt": [
        "staatstheater", "konzerthaus", "badische landesbibliothek", "zkm", "kunsthalle", "tollhaus", "jubez", "badischer kunstverein", "kunstmuseum", "planetarium", "hochschule für musik", "sandkorn", "marotte",
        "hemingway", "kulturzentrum tempel", "kulturhaus mikado", "galerie kunstfachwerk", "badisch bühn", "vhs karlsruhe", "unitheater", "triangel", "substage", "minestrone", "fächerresidenz", "orgelfabrik",
        "neuen ständehaus", "amerikanische bibliothek", "kunstfachwerk",
    ],
}

DISTRICT_EXCLUSIONS = {"Spöck": ["spöcker weg", "spoecker weg"], "Büchenau": ["staffort-büchenau", "staffort büchenau"]}

BLOCKED_TITLES = [
    "Krabbelkäfer Stutensee-Büchig – gemütliches Beisammensein mit Frühstück",
    "Bereitschaftsabend (Übungsabend)",
    "Chorprobe Gospel Unlimited",
    "Chorprobe Posaunenchor Blankenloch",
    "JRK Gruppenstunde",
    "Paddeltraining für Erwachsene (Sommer)",
    "Treffen für Vorstände und Verantwortliche",
    "Altpapiersammlung",
    "Mittagstisch – Wir veranstalten abends unseren Sommerbiergarten, deswegen müssen wir den Mittagstisch leider absagen.",
]

BLOCKED_PREFIXES = ["Altpapiersammlung"]

ORGANIZER_ALIASES = {"SV Staffort e.V.": "Sportverein Staffort e.V."}

MANUAL_ORG_MERGE = {"Gesamtelternbeirat": "Gesamtelternbeirat und Eltern der Stutenseer Kindergärten"}

MANUAL_DUPES = {
    "Hähnchen Grillfest": ["Hähnchenfest"],
    "Sommerfest am Baggersee": ["Sommerfest"],
    "Oldtimer- und Traktortreff": ["Oldtimer und Traktorentreff in Staffort"],
    "Topiblütenlauf": ["Topiblüten-Lauf"],
    "Tag des Kinderturnens beim TV Friedrichstal": ["Tag des Kinderturnens"],
    "Weihnachtskonzert": ["Weihnachtskonzert"],
}

FEATURED_IDS = [550368, 550380, 550587, 550627]

TITLE_EXCLUSIVE_TAGS = {"krabbelgruppe": "Kinder", "fit in der schwangerschaft": "Kinder", "vögel": "Natur"}

TITLE_ALWAYS_TAGS = {
    "tanzen für die kleinsten": ["Kinder"],
    "4-6 jahre": ["Kinder"],
    "3–6 jahre": ["Kinder"],
    "seesternchengarde": ["Kinder"],
    "remember in concert": ["Musik"],
    "landesmeutenaktion (lama)": ["Natur"],
    "fête de la musique": ["Musik"],
    "abifeier": ["Fest"],
    "'leben im alter - denken hält fit'": ["Senioren"],
    "aktionstage 60+": ["Senioren"],
    "herbstfahrt 2026": ["Natur"],
    "gemarkungsputzete": ["Natur"],
    "thanksgivin‘": ["Fest"],
    "großer pflegetag": ["Senioren"],
    "kampagne eröffnung / inthronisation": ["Kultur"],
    "saueressen kirwe": ["Fest"],
    "adventskranzbinden": ["Workshop"],
}

FALSE_POSITIVES = {
    "Essen": ["bieringer", "bieringer-str"],
    "Fest": ["standfest"],
    "Kirche": ["lutherkirche", "messen"],
    "Natur": ["waldstadt"],
    "Sport": ["jam session", "jam-session", "konrad", "bereiten"],
    "Musik": ["kückenstube", "eltern-baby-café", "krabbelgruppe", "eltern-kind-kreis", "eltern-kind-café", "eltern-kind-gruppe", "babycafé", "babytreff", "choreografien", "mitgliedern", "mitglieder"],
    "Workshop": ["jugendrotkreuz", "pfadfind"],
}

ORGANIZER_EXCLUSIVE_TAGS = {"agendagruppe umwelt": "Natur", "fc ": "Sport", "jugendzentrum graubau": "Blankenloch", "vogelliebhaber graben": "Graben-Neudorf", "cvjm": "Kirche"}

GENERIC_TITLES = ["gottesdienst", "gottesdienst mit posaunenchor", "oekumenischer gottesdienst", "center", "lichtblick", "maenner vesper", "vesper", "altpapiersammlung"]

GERMAN_MONTHS = ["januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"]

AVAILABLE_DISTRICTS = ["Blankenloch", "Bruchsal", "Büchenau", "Büchig", "Eggenstein", "Friedrichstal", "Graben-Neudorf", "Hagsfeld", "Leopoldshafen", "Linkenheim", "Neureut", "Neuthard", "Rintheim", "Spöck", "Staffort", "Waldstadt", "Weingarten"]

QUALITY_AXES = ["title_quality", "location_extraction", "time_extraction", "description_quality", "tag_quality", "duplicate_risk"]

# End of the fixed values.


@dataclass
class TagRules:
    """What auto-tagging reads. ``keywords`` (tag to substrings, in order) is a parameter: pass it or load it with ``load_keywords``."""

    keywords: dict[str, list[str]] = field(default_factory=dict)
    title_exclusive: dict[str, str] = field(default_factory=lambda: TITLE_EXCLUSIVE_TAGS)
    organizer_exclusive: dict[str, str] = field(default_factory=lambda: ORGANIZER_EXCLUSIVE_TAGS)
    false_positives: dict[str, list[str]] = field(default_factory=lambda: FALSE_POSITIVES)
    title_always: dict[str, list[str]] = field(default_factory=lambda: TITLE_ALWAYS_TAGS)
    districts: dict[str, list[str]] = field(default_factory=lambda: DISTRICTS)
    district_exclusions: dict[str, list[str]] = field(default_factory=lambda: DISTRICT_EXCLUSIONS)
    most_content_tags: int = 2


def load_keywords(path: str) -> dict[str, list[str]]:
    """Tag keywords from a JSON object of lists; its order is kept."""
    with open(path, encoding="utf-8") as f:
        return {str(tag): [str(k) for k in words] for tag, words in json.load(f).items()}
