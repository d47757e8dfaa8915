"""Text as column expressions: splitting, tokens, cleaning, matching. All JVM-side; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: what counts as white space, spelled out so that every engine agrees.
SPACE = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORDISH = r"[\p{L}\p{N}_]+"

#: Words that carry no content when passages are ranked, and when sentences are.
QUERY_STOPWORDS = "a an the and or but in on at to for of with by from is was are were be been have has had do does did will would could should that this it not no can as so if what which who when where how i you we they".split()
SENTENCE_STOPWORDS = "a an the and or but in on at to for of with by from is was are were be been have has had do does did will would could should may might that this it he she they we you i not no can as so if then also its their our your my his her than more about which who what when where how all any both each few into through during before after above below just because while there very too only up out over such being between here them these those per etc eg ie said says one two".split()


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def content_tokens(c: Column) -> Column:
    """The set of content words: three letters and more, or letters followed by figures; no stopwords, no bare numbers."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit(f"({WORDISH})"), F.lit(1)), lambda x: x.rlike("^([a-z]{3,}|[a-z]+[0-9]+)$"))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, QUERY_STOPWORDS)))


def term_list(c: Column) -> Column:
    """Words of three and more ASCII letters in order, lower case, without the stopwords of sentences."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit(f"({WORDISH})"), F.lit(1)), lambda x: x.rlike("^[a-z]{3,}$"))
    stop = F.array(*map(F.lit, SENTENCE_STOPWORDS))
    return F.filter(found, lambda x: ~F.array_contains(stop, x))


def sentences(c: Column) -> Column:
    """Sentences of more than 25 characters."""
    return F.filter(F.transform(F.split(c, rf"(?<=[.!?]){SPACE}+"), strip), lambda x: F.length(x) > 25)


def clean(c: Column) -> Column:
    """Line ends, words hyphenated across lines, page-number lines, empty bullets, runs of blank lines, trailing blanks.

    Order matters: blank runs collapse before trailing blanks go, so lines of blanks stay as empty lines.
    """
    t = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    t = F.regexp_replace(t, r"(?imd)^[ \t]*(page[ \t]*[0-9]+([ \t]+of[ \t]+[0-9]+)?|[0-9]+[ \t]*/[ \t]*[0-9]+)[ \t]*$", "")
    t = F.regexp_replace(t, r"(?md)^[ \t]*[-•◦▪·][ \t]*$", "")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r"(?md)[ \t]+$", ""))


def squeeze_layout(c: Column) -> Column:
    """Runs of three and more blanks become two; lines of white space go."""
    return F.regexp_replace(F.regexp_replace(c, " {3,}", "  "), r"\n[ \t]*\n", "\n")


def normal_question(c: Column) -> Column:
    """The form under which questions are compared."""
    return F.regexp_replace(F.regexp_replace(strip(F.lower(c)), "[?. ]+$", ""), f"{SPACE}+", " ")


def clean_question(c: Column) -> Column:
    """A question without numbering, prefix, bold, references and the word required; first letter upper case."""
    q = strip(F.regexp_replace(c, r"^[ \t]*([0-9]{1,3}[.)\-]|[a-eA-E][.)])[ \t]*", ""))
    q = strip(F.regexp_replace(q, r"(?i)^(question[ \t]*[0-9]*\.?|q\.?[ \t]*[0-9]*\.?)[ \t]*[:\-]?[ \t]*", ""))
    q = strip(F.regexp_replace(q, r"\*{1,2}([^*]+)\*{1,2}", "$1"))
    q = strip(F.regexp_replace(q, r"(?i)[ \t]+\(see [A-Za-z0-9_ ]*\)$", ""))
    q = strip(F.regexp_replace(q, r"(?i)[ \t]*[\[(]?[ \t]*required[ \t]*[\])]?[ \t]*$", ""))
    return F.concat(F.upper(F.substring(q, 1, 1)), q.substr(F.lit(2), F.length(q)))


#: Fixed value: blanks of fixed width.
FIXED_SPACES = "\u00a0\u202f\u2009\u2007"


def fold_for_match(c: Column) -> Column:
    """Typography folded away: case, fixed spaces, dashes, quotes, commas inside numbers, hyphens between letters."""
    t = F.translate(F.lower(c), FIXED_SPACES + "\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201c\u201d", "    -----''\"\"")
    t = F.regexp_replace(t, "(?<=[0-9]),(?=[0-9])", "")
    t = F.regexp_replace(t, "(?<=[a-z])-(?=[a-z])", " ")
    return F.regexp_replace(t, f"{SPACE}+", " ")


def contains_value(reply: Column, fragment: Column) -> Column:
    """Whether ``fragment`` stands in ``reply`` as a whole value, not as part of a longer number or word."""
    needle, hay = fold_for_match(fragment), fold_for_match(reply)
    left = F.when(needle.rlike("^[0-9]"), F.lit(r"(?<![0-9])(?<![0-9]\.)")).otherwise(F.lit(r"(?<![\p{L}\p{N}_])"))
    right = F.when(needle.rlike("[0-9]$"), F.lit(r"(?![0-9])(?!\.[0-9])")).otherwise(F.lit(r"(?![\p{L}\p{N}_])"))
    return (needle != "") & F.rlike(hay, F.concat(left, F.lit("\\Q"), needle, F.lit("\\E"), right))


#: Ways to say that the context holds no answer.
DECLINE = r"(?i)\b(not (found|available|present|stated|specified|mentioned|included|provided|contained|given)|no (information|mention|reference|figure|data|detail|record|breakdown)|(does|do) not (contain|state|mention|specify|provide|include|give|list)|(don't|doesn't) (contain|state|mention|specify|provide|include)|(states?|gives?|lists?|provides?|specif(y|ies)|contains?|mentions?|includes?) no\b|cannot (be )?(determin|answer|find|establish)|can't (be )?(determin|answer|find)|unable to (find|answer|determine)|(isn't|is not) (in|available|provided)|only (list|cover|give|state)s?\b)"


def declines(c: Column) -> Column:
    return F.coalesce(c.rlike(DECLINE), F.lit(False))


def duration_seconds(c: Column) -> Column:
    """Seconds of ``1h16m19.2s``, ``185ms`` or ``60``; null for anything else."""
    t = strip(c)
    number = r"[0-9]+(?:\.[0-9]+)?"
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(t, rf"({number}){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    compound = part("h") * 3600 + part("m(?:[^s]|$)") * 60 + part("(?<!m)s") + part("ms") / 1000
    return F.when(t.rlike(rf"^{number}$"), t.cast("double")).when(t.rlike(rf"^({number}h)?({number}m)?({number}s)?({number}ms)?$") & (t != ""), compound)


def source_label(document: Column, page: Column, sheet: Column) -> Column:
    """``Page n``, ``Sheet: x`` or ``Unknown source``, after the document's name if there is one."""
    where = F.when(page.isNotNull(), F.concat(F.lit("Page "), page.cast("string"))).when(F.coalesce(sheet, F.lit("")) != "", F.concat(F.lit("Sheet: "), sheet)).otherwise(F.lit("Unknown source"))
    return F.when(F.coalesce(document, F.lit("")) != "", F.concat(document, F.lit(", "), where)).otherwise(where)


def unfenced(c: Column) -> Column:
    """A reply without the fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")


def escaped(c: Column) -> Column:
    """Text for a page: the characters with a meaning in HTML as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def highlighted(c: Column, term: Column) -> Column:
    """Text for a page with every place of ``term`` marked, whatever its case; an empty term marks nothing."""
    quoted = F.concat(F.lit("(?i)(\\Q"), F.replace(escaped(term), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(term == "", escaped(c)).otherwise(F.regexp_replace(escaped(c), quoted, F.lit("<mark>$1</mark>")))


#: Fixed value: a page that a reply claims.
CLAIM = r"(?i)\bpages?\s+(\d+)|\bp\.?\s*(\d+)\b"


def claimed_pages(c: Column) -> Column:
    """The page numbers that a reply names, distinct and in order of number; numbers beyond ten digits are none."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CLAIM), F.lit(0))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, lambda x: F.regexp_extract(x, r"\d+", 0).try_cast("bigint")))))


#: Marks of a key that was never filled in, and the fewest characters of a key.
PLACEHOLDERS, LEAST_KEY = ("PASTE", "REPLACE_ME", "REPLACEME", "YOUR_", "_HERE", "CHANGE_ME", "CHANGEME", "DUMMY"), 20


def key_fault(c: Column) -> Column:
    """Why a key cannot be used: ``placeholder``, ``short`` or ``white space``; null for a plausible one."""
    marked = F.array_contains(F.transform(F.array(*map(F.lit, PLACEHOLDERS)), lambda m: F.upper(c).contains(m)), True)
    return F.when(marked, "placeholder").when(F.coalesce(F.length(c), F.lit(0)) < LEAST_KEY, "short").when(c.rlike(SPACE), "white space")
