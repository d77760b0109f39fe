"""Text functions as columns: normalisers, extractors, tokens, linters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seniority words, company suffixes, weak openings, buzzwords, fillers.
SENIORITY = ("senior", "junior", "lead", "principal", "staff", "mid", "associate")
COMPANY_SUFFIXES = ("inc", "ltd", "llc", "corp", "limited", "plc", "gmbh")
WEAK_VERBS = {"responsible for": "led", "worked on": "built", "helped with": "supported", "was involved in": "drove"}
FILLERS = ("very", "really", "just", "basically", "actually")


def words(text: Column, shortest: int = 1) -> Column:
    """Lower-cased runs of letters of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= shortest)


def term_tokens(text: Column) -> Column:
    """Lower-cased tokens a skill dictionary knows: letters and digits, with the signs of c#, c++ and .net."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[.]?[\p{L}\p{N}]+[+#]*"), 0)


def normalise_value(text: Column) -> Column:
    """Trimmed, lower-cased, without . , ( )."""
    return F.translate(F.lower(F.trim(text)), ".,()", "")


def normalise_title(text: Column) -> Column:
    """Lower-cased title without seniority words, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"\b(" + "|".join(SENIORITY) + r")\b", "")
    return F.regexp_replace(F.trim(bare), r"\s{2,}", " ")


def normalise_company(text: Column) -> Column:
    """Lower-cased name without one trailing legal suffix."""
    return F.trim(F.regexp_replace(F.lower(F.trim(text)), r"[ ,]+(" + "|".join(COMPANY_SUFFIXES) + r")\.?$", ""))


def collapse_spaced(text: Column) -> Column:
    """A heading spelled with a blank after every letter ("S K I L L S") put together; wider gaps part words.

    Only where at least three, and three fifths, of its tokens are single characters.
    """
    tokens = F.filter(F.split(text, " "), lambda x: x != "")
    single = F.size(F.filter(tokens, lambda x: F.length(x) == 1))
    joined = F.regexp_replace(text, r"(?<=(?<!\S)\S) (?=\S(?!\S))", "")
    spelled = (single >= 3) & (single >= 0.6 * F.size(tokens))
    return F.when(spelled, F.trim(F.regexp_replace(joined, " +", " "))).otherwise(text)


def title_similarity(a: Column, b: Column) -> Column:
    """Common words over the size of the larger word set."""
    x, y = F.array_distinct(F.split(a, " +")), F.array_distinct(F.split(b, " +"))
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1))


def email_domain(address: Column) -> Column:
    return F.lower(F.substring_index(address, "@", -1))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def paren_split(text: Column) -> Column:
    """Comma-separated items; commas inside one level of parentheses part nothing."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"((?:[^,(]|\([^)]*\))+)"), 1), lambda x: F.trim(x)), lambda x: x != "")


def first_match(text: Column, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """Label of the first rule one of whose keywords is in the text; rule order wins."""
    out = F.lit(default)
    for label, keywords in reversed(rules):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | text.contains(k)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def all_matches(text: Column, rules: list[tuple[str, tuple[str, ...]]]) -> Column:
    """Labels of every rule one of whose keywords is in the text."""
    hits = []
    for label, keywords in rules:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | text.contains(k)
        hits.append(F.when(hit, F.lit(label)))
    return F.array_compact(F.array(*hits))


#: Education levels, highest first, by the marks of their degrees.
EDUCATION = [
    ("Doctoral", ("phd", "doctorate", "dphil")),
    ("Masters", ("master", "msc", "mba", "meng")),
    ("Bachelors", ("bachelor", "bsc", "beng", "hons")),
    ("Vocational", ("hnd", "hnc", "btec")),
    ("PostSecondary", ("a-level", "higher", "abitur")),
    ("Secondary", ("gcse", "o-level", "high school")),
]


def education_level(degree: Column) -> Column:
    """Highest education level a degree's text names; Unknown without one."""
    return first_match(F.lower(F.coalesce(degree, F.lit(""))), EDUCATION, "Unknown")


def meets_education(level: Column, required: str) -> Column:
    """Whether a level is at least the required one; an unknown requirement is met by all."""
    names = [n for n, _ in EDUCATION]
    return F.lit(True) if required not in names else level.isin(names[: names.index(required) + 1])


#: Forms of a salary, in order; the range, then a currency and a period that the form implies.
SALARY_FORMS = [
    (r"[£$€]([0-9,]+)\s*[-–]\s*[£$€]?([0-9,]+)", None, None),
    (r"(?i)([0-9]+)k\s*[-–]\s*[^0-9]?([0-9]+)k", None, None),
    (r"(?i)RM\s*([0-9,]+)\s*[-–]\s*RM\s*([0-9,]+)", "MYR", "monthly"),
    (r"([0-9]{2,3},[0-9]{3})\s*[-–]\s*([0-9]{2,3},[0-9]{3})", None, None),
    (r"(?i)(?:salary|compensation|pay)[:\s]*[$]?([0-9,]+[.]?[0-9]*)()", None, None),
]
CURRENCIES = {"£": "GBP", "$": "USD", "€": "EUR"}
#: Forms of asked experience, in order; the last needs no word for it.
YEARS_FORMS = [
    r"(?i)([0-9]+)\+?\s*years?\s+(?:of\s+)?(?:experience|exp)",
    r"(?i)(?:minimum|at least|min)\s+([0-9]+)\s*\+?\s*years?",
    r"(?i)([0-9]+)\s*[-–]\s*[0-9]+\s*years?\s+(?:of\s+)?(?:experience|exp)",
    r"(?i)([0-9]{1,2})\+? *(?:years|yrs)",
]


def salary(text: Column) -> Column:
    """struct(low, high, currency, period) of the first form of a salary that a text has; null without one.

    A single amount is both ends; numbers in thousands by "k"; currency by its sign or the form.
    """
    out = F.lit(None)
    for pattern, currency, period in reversed(SALARY_FORMS):
        low, high = (F.regexp_replace(F.regexp_extract(text, pattern, i), ",", "") for i in (1, 2))
        sign = F.substring(F.regexp_extract(text, pattern, 0), 1, 1)
        implied = F.lit(currency).cast("string")
        for mark, code in CURRENCIES.items():
            implied = F.when(sign == mark, code).otherwise(implied)
        times = 1000 if ")k" in pattern else 1
        amount = lambda x: x.try_cast("double") * times  # noqa: B023, E731
        ends = F.struct(amount(low).alias("low"), amount(F.when(high == "", low).otherwise(high)).alias("high"), implied.alias("currency"), F.lit(period).cast("string").alias("period"))
        out = F.when(low != "", ends).otherwise(out)
    return out


def salary_range(text: Column) -> tuple[Column, Column]:
    """(low, high) of ``salary`` in whole units."""
    return salary(text)["low"].cast("long"), salary(text)["high"].cast("long")


def claimed_years(text: Column) -> Column:
    """Years of experience asked for: the first form, in order, that gives fewer than fifty."""
    found = [F.regexp_extract(text, p, 1) for p in YEARS_FORMS]
    return F.coalesce(*[F.when((y != "") & (F.length(y) < 3) & (y.cast("int") < 50), y.cast("int")) for y in found])


MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_YEAR = "(?:19|20)[0-9]{2}"
_POINT = rf"(?:(?:0?[1-9]|1[0-2])[/.-]{_YEAR}|{_YEAR}[/.-](?:0[1-9]|1[0-2])(?![0-9])|(?:(?:{MONTHS})[a-z]*[.]? +)?{_YEAR})"
_RANGE = rf"(?<![0-9])(?:({_POINT}) *(?:-|–|—|to|until) *({_POINT}|present|current|now|to date|till now)|({_POINT}) *()to date)"


def date_range(text: Column) -> Column:
    """First range of a text: struct(start_date, end_date, is_current, match_start, match_end); null without one.

    Points are "Jan 2020", "2020", "01/2020" or "2020-01"; offsets count characters from 0, the end being the last of the match.
    """
    low = F.lower(text)

    def named(s: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS.split("|"))), F.regexp_extract(s, rf"^({MONTHS})", 1)).cast("int")
        number = F.concat(F.regexp_extract(s, r"^([0-9]{1,2})[/.-]", 1), F.regexp_extract(s, rf"^{_YEAR}[/.-]([0-9]{{2}})$", 1))
        year = F.regexp_extract(s, rf"({_YEAR})", 1)
        return F.when(year != "", F.make_date(year.cast("int"), F.when(number != "", number.cast("int")).when(month > 0, month).otherwise(1), F.lit(1)))

    a = F.concat(F.regexp_extract(low, _RANGE, 1), F.regexp_extract(low, _RANGE, 3))
    b, at = F.regexp_extract(low, _RANGE, 2), F.regexp_instr(low, F.lit(_RANGE)) - 1
    start = named(a)
    ends = (at.alias("match_start"), (at + F.length(F.regexp_extract(low, _RANGE, 0)) - 1).alias("match_end"))
    return F.when(start.isNotNull(), F.struct(start.alias("start_date"), named(b).alias("end_date"), named(b).isNull().alias("is_current"), *ends))


def by_distinct(rows: DataFrame, text: str, parse: Callable[[Column], Column], name: str) -> DataFrame:
    """The rows with ``parse`` of a text column as ``name``, parsed once a different text; null texts are parsed like others."""
    parsed = rows.select(text).distinct().withColumn(name, parse(F.col(text))).withColumnRenamed(text, "_text")
    return rows.join(parsed, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, blanks collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/]+)", 1)


def _meta(html: Column, name: str) -> Column:
    """Content of a page's Open Graph tag, by property or name; null where it is missing or blank."""
    tag = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:property|name)=[\"']{name}[\"'][^>]*>", 0)
    content = F.regexp_extract(tag, r"(?is)content=(\"|')(.*?)\1", 2)
    return F.when(F.trim(content) != "", content)


def json_ld_posting(html: Column) -> Column:
    """The first JobPosting of a page's JSON-LD blocks, and what Open Graph says.

    A block is an object, an array or an object with ``@graph``; the posting is the first of all items whose ``@type``, or
    the first name in it, contains "JobPosting" in any case.  A block that is not JSON has none.  A salary that is one
    number is both ends.
    """
    get = lambda j, p: F.get_json_object(j, p)
    many = lambda j: F.from_json(j, "array<string>")
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))

    def items(block: Column) -> Column:
        graph = get(block, "$.@graph")
        return F.coalesce(F.when(F.ltrim(block).rlike(r"^\s*\["), many(block)).when(graph.startswith("["), many(graph)).otherwise(F.array(block)), F.array().cast("array<string>"))

    def posting(item: Column) -> Column:
        kind = get(item, "$.@type")
        return F.coalesce(F.lower(F.when(kind.startswith("["), get(item, "$.@type[0]")).otherwise(kind)).contains("jobposting"), F.lit(False))

    job = F.get(F.filter(F.flatten(F.transform(blocks, items)), posting), F.lit(0))
    place = F.coalesce(get(job, "$.jobLocation.address.addressLocality"), get(job, "$.jobLocation[0].address.addressLocality"))
    amount = get(job, "$.baseSalary.value")
    ends = [F.coalesce(get(job, f"$.baseSalary.value.{x}Value"), amount).try_cast("double").alias(f"salary_{x}") for x in ("min", "max")]
    return F.struct(
        F.coalesce(get(job, "$.title"), _meta(html, "og:title")).alias("title"), get(job, "$.hiringOrganization.name").alias("company"), place.alias("location"), *ends,
        get(job, "$.baseSalary.currency").alias("salary_currency"), F.coalesce(F.upper(get(job, "$.jobLocationType")).contains("TELECOMMUTE"), F.lit(False)).alias("is_remote"),
        get(job, "$.employmentType").alias("employment_type"), _meta(html, "og:description").alias("description"),
    )


def rewrite(text: Column) -> Column:
    """Weak openings replaced, first-person pronouns and fillers dropped."""
    out = text
    for weak, strong in WEAK_VERBS.items():
        out = F.regexp_replace(out, f"(?i){re.escape(weak)}", strong)
    # Look-arounds leave the blanks in place, so that neighbours are all found.
    out = F.regexp_replace(out, r"(?<![^ ])(?:I|my|me|" + "|".join(FILLERS) + r")(?![^ ])", "")
    return F.trim(F.regexp_replace(out, " +", " "))


def truncate(text: Column, most: int = 60) -> Column:
    """At most ``most`` characters, the last three of a cut text being dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def trim_chars(text: Column, chars: str) -> Column:
    """Without any of ``chars`` at either end."""
    return F.btrim(text, F.lit(chars))


def is_name_like(name: Column) -> Column:
    """Two to five words of letters (with . ' -), each beginning with a capital."""
    return F.coalesce(name.rlike(r"^\p{Lu}[\p{L}.'-]*( \p{Lu}[\p{L}.'-]*){1,4}$"), F.lit(False))


def join_initials(text: Column) -> Column:
    """A name whose capitals stand apart from their words ("F ELIPE M AGNO") put together; null where it does not look so.

    It does with four words or more of which two or more are single letters, one of them a capital before a longer
    word, and two words or more left in the end.
    """
    words = F.filter(F.split(text, " "), lambda w: w != "")
    singles = F.size(F.filter(words, lambda w: w.rlike(r"^\p{L}$")))
    spaced = F.array_join(words, " ")
    joined = F.regexp_replace(spaced, r"(^| )(\p{Lu}) ([^ ]{2,})", "$1$2$3")
    return F.when((F.size(words) >= 4) & (singles >= 2) & (joined != spaced) & joined.contains(" "), F.initcap(F.lower(joined)))


def repair_name(name: Column) -> Column:
    """Spaced letters put together, joined words parted at capitals, all capitals turned to title case."""
    joined = collapse_spaced(name)
    parted = F.when(joined.contains(" "), joined).otherwise(F.regexp_replace(joined, r"(?<=\p{Ll})(?=\p{Lu})", " "))
    return F.when(F.upper(parted) == parted, F.initcap(F.lower(parted))).otherwise(parted)


#: Headings of the sections of a profile, by what they contain.
HEADINGS = [
    ("Experience", ("experience", "employment", "work history", "career")),
    ("Education", ("education", "academic", "qualifications")),
    ("Skills", ("skills", "technologies", "competencies", "expertise")),
    ("Projects", ("projects", "portfolio")),
    ("Certifications", ("certifications", "certificates", "licenses")),
    ("Summary", ("summary", "profile", "objective", "about")),
]


def heading_class(line: Column) -> Column:
    """Section a heading of up to 60 characters opens; null for any other line."""
    label = first_match(F.lower(collapse_spaced(line)), HEADINGS, "")
    return F.when((F.length(line) <= 60) & (label != ""), label)


#: ISCED level of each education level.
ISCED = {"Doctoral": 8, "Masters": 7, "Bachelors": 6, "Vocational": 5, "PostSecondary": 4, "Secondary": 3}


def isced(level: Column) -> Column:
    """ISCED level of an education level; 0 where unknown."""
    out = F.lit(0)
    for name, n in ISCED.items():
        out = F.when(level == name, n).otherwise(out)
    return out


def relative_age(days: Column) -> Column:
    """today, 3d ago, 2w ago, 5mo ago, 1y ago."""
    ago = lambda n, unit: F.concat(F.floor(days / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(days < 1, "today").when(days < 7, ago(1, "d")).when(days < 30, ago(7, "w")).when(days < 365, ago(30, "mo")).otherwise(ago(365, "y"))


def fenced_json(text: Column) -> Column:
    """The outermost JSON object of an answer that may be fenced or talked around; null without one."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)
