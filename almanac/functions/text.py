"""Column builders for text: normal forms used as keys, clean forms used for storage, slugs and labels."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from almanac import dictionaries as D


# What style sheets leave behind in scraped text.
STYLE_REMNANTS = [
    r"""\*?\](?:\s*:\s*[-\w]+)*[-\w="'\[\]()+,.#% \t]*?(?:scroll-mt-|dir=|tabindex|data-)[-\w="'\[\]()+,.#% \t]*""",
    r"\+min\([^)]+\)\)\)\s*>",
    r"calc\([^)]*\)",
]
# End of the fixed values.


def _lit_regex(texts: Sequence[str]) -> str:
    return "|".join(r"\Q" + t + r"\E" for t in texts)


def empty(c: Column) -> Column:
    """Null as ''."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at the ends, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def contains_any(c: Column, texts: Sequence[str]) -> Column:
    """Whether one of the texts occurs; one regular expression instead of a chain of searches."""
    return c.rlike(_lit_regex(texts)) if texts else F.lit(False)


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def normalize_title(c: Column, suffixes: Sequence[str] = D.DISTRICT_SUFFIXES) -> Column:
    """Key of a title: lower case, without dashes and slashes, every district suffix dropped wherever it stands."""
    t = F.regexp_replace(strip(F.lower(empty(c))), "[-–—/]", "")
    for s in suffixes:
        t = F.replace(t, F.lit(s), F.lit(""))
    return t


def title_key_cased(c: Column, suffixes: Sequence[str] = D.DISTRICT_SUFFIXES) -> Column:
    """The older key: suffixes are dropped before lower-casing, dashes stay."""
    t = empty(c)
    for s in suffixes:
        t = F.replace(t, F.lit(s), F.lit(""))
    return F.lower(strip(t))


def normalize_location(c: Column) -> Column:
    """What stands before the first comma, unless that is the first character."""
    loc = strip(empty(c))
    return F.when(F.instr(loc, ",") > 1, strip(F.substring_index(loc, ",", 1))).otherwise(loc)


def normalize_location_dedup(c: Column, core: Sequence[str] = D.CORE_DISTRICTS, districts: dict[str, list[str]] = D.DISTRICTS) -> Column:
    """A place as a block key: the first core district in it, else the district of a keyword, else what stands before the comma."""
    loc = F.lower(strip(empty(c)))
    tests = [F.when(F.contains(loc, F.lit(d)), F.lit(d)) for d in core] + [F.when(contains_any(loc, words), F.lit(d)) for d, words in districts.items()]
    return F.coalesce(*tests, normalize_location(loc))


def clean_organizer(c: Column, aliases: dict[str, str] = D.ORGANIZER_ALIASES) -> Column:
    """Organizer for storage: without the scraped prefix, aliases replaced."""
    o = strip(F.regexp_replace(c, r"(?iu)^Veranstalter:\s*", ""))
    for alias, name in aliases.items():
        o = F.replace(o, F.lit(alias), F.lit(name))
    return o


def squeeze(c: Column) -> Column:
    """Lower case without white space and ``. , ; : -``."""
    return F.regexp_replace(F.lower(empty(c)), r"(?U)[\s.,;:-]+", "")


def normalize_organizer(c: Column) -> Column:
    return squeeze(clean_organizer(empty(c)))


def organizer_without_form(c: Column) -> Column:
    """Organizer key without legal forms; the final full stop of 'e.v.' stays, as no word boundary follows it."""
    o = F.lower(strip(empty(c)))
    o = strip(F.regexp_replace(o, r"(?U)\be\.\s*v\.?\b", ""))
    o = strip(F.regexp_replace(o, r"(?U)\beingetragener\s+verein\b", ""))
    return strip(F.regexp_replace(o, r"(?U)\s+", " "))


def slugify(c: Column, most: int | None = 60) -> Column:
    """Title as part of a name, of ``most`` letters; whole if that is None."""
    s = F.lower(strip(empty(c)))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, r"[^a-z0-9\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s-]+", "-"), r"^-+|-+$", "")
    if most is not None:
        s = F.regexp_replace(F.substring(s, 1, most), r"-+$", "")
    return F.when(s == "", F.lit("event")).otherwise(s)


def file_name(date: Column, title: Column, most: int | None = 60) -> Column:
    return F.concat(F.when(empty(date) == "", F.lit("unknown")).otherwise(date), F.lit("_"), slugify(title, most), F.lit(".json"))


def strip_html(c: Column, gap: str = " ") -> Column:
    """Tags out, white space collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(empty(c), "<[^>]+>", gap), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def html_unescape(c: Column) -> Column:
    """Character references decoded. Spark has no such function; only texts with an ampersand are sent to Python's."""
    return F.when(F.contains(c, F.lit("&")), _unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def decode_basic(c: Column) -> Column:
    """The references that hand-written pages use most, without leaving the JVM; the ampersand last."""
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def first_name(obj: Column, path: str) -> Column:
    """``name`` of a JSON-LD object or of the first in a list; '' else."""
    return empty(F.coalesce(F.get_json_object(obj, f"$.{path}.name"), F.get_json_object(obj, f"$.{path}[0].name")))


def clean_event_url(c: Column) -> Column:
    """Without session parameters."""
    return F.regexp_replace(F.regexp_replace(c, r"[?&]zm\.sid=[^&]+", ""), r"[?&]+$", "")


def with_parameters(url: Column, prefix: str, marker: str, parameters: str) -> Column:
    """Add query parameters to URLs with a prefix that lack a marker."""
    joint = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.when(url.startswith(prefix) & ~F.contains(url, F.lit(marker)), F.concat(url, joint, F.lit(parameters))).otherwise(url)


def url_category(url: Column, names: dict[str, str], marker: str) -> Column:
    """Name of the path segment after ``marker``: looked up, else capitalized; '' without one."""
    segment = F.regexp_extract(F.lower(url), re.escape(marker) + r"([^/?#]+)", 1)
    known = F.coalesce(*[F.when(segment == k, F.lit(v)) for k, v in names.items()], F.initcap(F.replace(segment, F.lit("-"), F.lit(" "))))
    return F.when(empty(segment) == "", F.lit("")).otherwise(known)


def as_list(c: Column) -> Column:
    """Comma-separated text as a list of trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(empty(c), ","), strip), lambda x: x != "")


def without_year(c: Column) -> Column:
    """A title without a year at its end."""
    return strip(F.regexp_replace(c, r"\s*\(?\b20\d{2}\b\)?\s*$", ""))


def title_forms(c: Column) -> tuple[Column, Column]:
    """A title in lower case, and that without digits, dots and repeated spaces."""
    t = strip(F.lower(empty(c)))
    return t, strip(F.regexp_replace(t, r"(?U)[\d.\s]+", " "))


def title_similar(a: Column, b: Column) -> Column:
    """Equal but for digits, dots and spaces, or one contained in the other."""
    (x, x_bare), (y, y_bare) = title_forms(a), title_forms(b)
    return (x_bare == y_bare) | either_contains(x, y)


def description_steps(c: Column) -> dict[str, Column]:
    """What a description is after each step of cleaning: references decoded, tags out, odd spaces mended, runs of spaces collapsed, style remnants and leading bars dropped."""
    d = empty(c)
    steps = {"decoded": (d := F.when(F.contains(d, F.lit("&")) & F.contains(d, F.lit(";")), html_unescape(d)).otherwise(d))}
    steps["untagged"] = d = F.regexp_replace(d, "<[^>]*>", "")
    d = F.replace(F.replace(F.replace(d, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit("")), F.lit(" "), F.lit(" "))
    steps["mended"] = d
    d = F.regexp_replace(F.regexp_replace(F.regexp_replace(d, "[ \t]+", " "), r"\n\s*\n", "\n"), r"\n+", "\n")
    steps["spaced"] = d = strip(d)
    for p in STYLE_REMNANTS:
        d = F.regexp_replace(d, p, "")
    d = strip(F.regexp_replace(strip(d), r"^\|+", ""))
    steps["cleaned"] = strip(F.regexp_replace(d, r"(?U)\s{2,}", " "))
    return steps


def clean_description(c: Column) -> Column:
    """A description after all of ``description_steps``."""
    return description_steps(c)["cleaned"]


def short_description(c: Column) -> Column:
    """Tags out, references decoded, 'weiterlesen' and bare dots dropped. What is left with one to four characters should be looked up elsewhere."""
    d = html_unescape(F.regexp_replace(empty(c), "<[^>]*>", ""))
    d = F.regexp_replace(d, r"(?iu)\s*weiterlesen\s*$", "")
    return F.when(strip(d) == "...", F.lit("")).otherwise(d)


def flag_generic_title(c: Column, generic: Sequence[str] = D.GENERIC_TITLES) -> Column:
    """A title with a warning sign if it says little."""
    words = F.size(F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != ""))
    return F.when(F.lower(strip(c)).isin([*generic]) | (words <= 2) & (F.length(c) < 20), F.concat(c, F.lit(" ⚠️"))).otherwise(c)


def quality_badge(passed: Column, score: Column) -> Column:
    shown = F.format_string("%.2f", F.coalesce(score, F.lit(0.0)))
    return F.when(passed.isNull(), F.lit("—")).when(passed, F.concat(F.lit("✅ "), shown)).otherwise(F.concat(F.lit("❌ "), shown))


def first_label(c: Column, labels: Sequence[str], default: str) -> Column:
    """The first label that occurs in a text."""
    return F.coalesce(*[F.when(F.contains(F.lower(c), F.lit(x.lower())), F.lit(x)) for x in labels], F.lit(default))


def first_bold_line(c: Column) -> Column:
    return F.regexp_extract(empty(c), r"(?m)^\*\*(.*)\*\*\s*$", 1)


def as_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))
