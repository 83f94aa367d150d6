"""Text functions as column expressions; all run in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that are no topics, and the pattern of venue and task names.
GENERIC_LABELS = "machine task tasks learning model models data method methods approach paper analysis system systems network networks neural language deep".split()
JUNK_PATTERN = r"(\b(19|20)\d\d\b|\btask \d+|semeval|association computational|computational linguisti|meeting association|annual meeting|proceedings|workshop|conference|^based\b)"
# Fixed value: control characters that spreadsheets refuse.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f\ufeff\ufffe\uffff]"


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalise_keyword(c: Column) -> Column:
    return strip(collapse(F.lower(c)))


def normalise_title(c: Column) -> Column:
    """Lower case, hyphens and underscores as blanks, anything but a-z, 0-9 out."""
    c = F.regexp_replace(F.regexp_replace(F.lower(c), r"[-_]", " "), r"[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalise_phrase(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\-]+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs(words: Column, n: int) -> Column:
    """Runs of n words in order of place; those with a null word, and those that would go beyond the end, are left out."""

    def of(word: Column, i: Column) -> Column:
        # Joined by concat, which is null as soon as one part is.
        return F.concat(word, *[x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))])

    return F.array_compact(F.transform(words, of))


def ngrams(text: Column, least: int = 1, most: int = 5) -> Column:
    """All runs of least..most words of a blank-separated text, shorter runs first, each in order of place."""
    made = let(F.split(text, " "), lambda words: F.flatten(F.array(*[runs(words, n) for n in range(least, most + 1)])))
    return F.coalesce(made, F.array().cast("array<string>"))


def year_of(c: Column) -> Column:
    """"2020", "2020.0" and 2020 are years; anything else is null."""
    return c.cast("string").try_cast("double").try_cast("int")


def is_junk(c: Column) -> Column:
    return c.isin(*GENERIC_LABELS) | c.rlike(JUNK_PATTERN)


def must_regenerate(keywords: Column) -> Column:
    """No keywords, or author-made 'topic ...' labels."""
    return keywords.isNull() | (strip(keywords) == "") | F.lower(strip(keywords)).startswith("topic")


def has_abstract(abstract: Column, least: int = 30) -> Column:
    text = strip(abstract)
    return F.coalesce((F.lower(text) != "nan") & (F.length(text) >= least), F.lit(False))


def clean_abstract(c: Column) -> Column:
    return F.regexp_replace(strip(collapse(c)), r"(?i)^abstract[ :.\-]*", "")


def repair_url(c: Column) -> Column:
    """https:/host -> https://host."""
    return F.regexp_replace(c, r"^(https?):/(?!/)", "$1://")


def absolute_url(href: Column, base: str) -> Column:
    """Against a site's base: full, protocol-relative, rooted and relative links."""
    root = F.regexp_extract(F.lit(base), r"^(https?://[^/]+)", 1)
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))


def sanitise(c: Column, cap: int | None = None) -> Column:
    """Control characters as blanks; or removed, and the text cut at cap, as cells of spreadsheets need."""
    return F.regexp_replace(c, CONTROL, " ") if cap is None else F.substring(F.regexp_replace(c, CONTROL, ""), 1, cap)


def split_abbreviation(c: Column) -> Column:
    """"Phrase (ABBR)" as [Phrase, ABBR]; any other phrase as itself."""
    pattern = r"\s*\(([A-Za-z0-9]{2,15})\)\s*$"
    parts = F.array(F.trim(F.regexp_replace(c, pattern, "")), F.regexp_extract(c, pattern, 1))
    return F.when(c.rlike(pattern), F.filter(parts, lambda x: x != "")).otherwise(F.array(c))


def date_of_millis(c: Column) -> Column:
    """The day in UTC, whatever the session's zone; years beyond 9999 without the sign that Spark puts before them. Null where no calendar reaches."""
    days = ((c - F.pmod(c, F.lit(86_400_000))) / 86_400_000).cast("long").try_cast("int")
    return F.regexp_replace(F.date_from_unix_date(days).cast("string"), r"^\+", "")


def is_short(keywords: Column, least: int = 10) -> Column:
    """Keywords that are absent or of fewer characters: to be enriched."""
    return F.length(F.coalesce(keywords, F.lit(""))) < least


def update_where(test: Column, value: Column, old: Column, empty_too: bool = True) -> Column:
    """``value`` where the test holds, else ``old``; an empty or null value only counts with empty_too, as the empty text."""
    return F.when(F.coalesce(test, F.lit(False)), F.coalesce(value, F.lit("")) if empty_too else F.when(value != "", value).otherwise(old)).otherwise(old)


# Ends of the addresses of abstract pages; the first that fits counts.
ABSTRACT_PAGES = ("-Abstract.html", "-Abstract-Conference.html", "-Abstract-Datasets_and_Benchmarks_Track.html")


def pdf_of(url: Column) -> Column:
    """The PDF file that belongs to an abstract page, by the names of the three proceedings' sites."""
    out = F.when(url.contains(ABSTRACT_PAGES[0]), F.replace(url, F.lit(ABSTRACT_PAGES[0]), F.lit(".pdf")))
    for end in ABSTRACT_PAGES[1:]:
        out = out.when(url.contains(end), F.replace(url, F.lit(end), F.lit(".pdf")))
    out = out.when(url.contains("_paper.html"), F.replace(F.replace(url, F.lit("_paper.html"), F.lit("_paper.pdf")), F.lit("/html/"), F.lit("/papers/")))
    return out.when(url.endswith(".html"), F.regexp_replace(url, r"\.html$", ".pdf")).otherwise(url)


def paper_id_of(url: Column) -> Column:
    """The last part of an address without what marks it as a paper's page or file."""
    ends = "|".join(e.replace(".", r"\.") for e in (*ABSTRACT_PAGES, "_paper.html", "_paper.pdf", ".html"))
    return F.regexp_replace(F.substring_index(url, "/", -1), f"(?:{ends})$", "")


def volume_of(url: Column) -> Column:
    return F.regexp_extract(url, r"/v(\d+)/", 1)


def authors_after(text: Column, title: Column) -> Column:
    """What a listing's line says after the title, without its links in brackets and commas at the ends."""
    line = F.when(text.contains("["), strip(F.substring_index(text, "[", 1))).otherwise(text)
    at = F.instr(line, title)
    rest = F.when(at > 0, F.substring(line, at + F.length(title), F.length(line))).otherwise("")
    return strip(F.regexp_replace(strip(rest), "^,+|,+$", ""))


def last_first(last: Column, first: Column) -> Column:
    """"Last, First"; either alone without the comma."""
    return F.btrim(F.concat_ws(", ", F.coalesce(last, F.lit("")), F.coalesce(first, F.lit(""))), F.lit(", "))


def file_safe(c: Column) -> Column:
    """Anything but letters, digits, underscores and hyphens as an underscore."""
    return F.regexp_replace(c, r"(?U)[^\w\-]", "_")


def plain(c: Column) -> Column:
    """Stripped text; null and "nan" are empty."""
    return F.when(c.isNull() | (F.lower(strip(c)) == "nan"), "").otherwise(strip(c))


def document(title: Column, abstract: Column, least: int = 40, cap: int = 8000) -> Column:
    """"Title. Abstract" with the abstract's first characters; the title alone if the abstract is short."""
    t, a = strip(F.coalesce(title, F.lit(""))), plain(abstract)
    body = F.substring(a, 1, cap)
    return F.when(F.length(a) < least, t).when(t != "", F.concat(t, F.lit(". "), body)).otherwise(body)


def sentences(c: Column) -> Column:
    return F.split(c, r"(?U)[.!?]\s+", -1)


def words(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter, else lower case: of what, say, hyphens join, each part."""
    letters = F.split(F.lower(c), "")
    after = F.concat(F.array(F.lit(" ")), F.slice(letters, F.lit(1), F.greatest(F.size(letters) - 1, F.lit(0))))
    one = lambda x: F.when(x["b"].rlike(r"\p{L}"), x["a"]).otherwise(F.upper(x["a"]))
    return F.array_join(F.transform(F.arrays_zip(letters.alias("a"), after.alias("b")), one), "")


def axis_label(c: Column, most: int = 28, cased: bool = False) -> Column:
    return F.substring(title_case(c) if cased else c, 1, most)


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c.cast("double") * 100)


def grouped(c: Column, digits: int = 0) -> Column:
    """Thousands set off by commas."""
    return F.format_number(c, digits)


def year_of_acl_id(c: Column) -> Column:
    """2020.acl-long.1 is of 2020, the older P18-1001 of 2018."""
    new = F.regexp_extract(c, r"^(\d{4})\.", 1)
    old = F.regexp_extract(c, r"^P(\d\d).", 1)
    return F.when(new != "", new.cast("int")).when(~c.contains(".") & (old != ""), F.lit(2000) + old.cast("int"))


def volume_of_acl_id(c: Column) -> Column:
    """acl-long of 2020.acl-long.1; empty for older ids."""
    return F.lower(F.get(F.split(c, r"\."), F.lit(1)))


def paper_type_of(venue_id: Column) -> Column:
    return F.when(F.coalesce(venue_id, F.lit("")).contains("/Workshop"), "workshop").otherwise("main")
