"""Column functions for text: cleaning, keys, slugs, markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Articles and demonstratives that a match key loses, in this order, each once.
KEY_PREFIXES = ("the ", "a ", "an ", "this ", "that ", "these ", "those ")
#: Direction controls, and the Hebrew quotation marks with their ASCII forms.
BIDI = "[\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]"
#: Unicode's space separators (Zs).
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HEBREW_QUOTES, PLAIN_QUOTES = "\u05f4\u05f3", "\"'"


def replace_all(c: Column, patterns: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p[0], p[1]), patterns, c)


def stripped(c: Column) -> Column:
    """Without white space at its ends, line ends included."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def clean(c: Column, boilerplate: tuple[str, ...] = ()) -> Column:
    """Boilerplate patterns go, whatever their case; three line ends or more become two; ends are trimmed."""
    return stripped(F.regexp_replace(replace_all(c, [("(?i)" + p, "") for p in boilerplate]), "\n{3,}", "\n\n"))


def collapse_lines(c: Column) -> Column:
    """Blanks and tabs collapse within lines, which lose the blanks of any width at their ends; line ends stay."""
    return F.array_join(F.transform(F.split(F.regexp_replace(c, "[ \t]+", " "), "\n"), lambda x: F.btrim(x, F.lit(SPACES))), "\n")


def plain_quotes(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, BIDI, ""), HEBREW_QUOTES, PLAIN_QUOTES)


def surface(c: Column) -> Column:
    """An entity's surface: markup edges and punctuation at both ends go, blanks collapse."""
    return F.regexp_replace(F.btrim(F.regexp_replace(F.trim(c), "^[*:#\\s]+|[*:#\\s]+$", ""), F.lit(".,;:!?()[]{}\"'-")), " +", " ")


def match_key(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, "^" + p, ""), KEY_PREFIXES, F.trim(F.lower(c)))


def slug(kind: str, c: Column, limit: int = 50) -> Column:
    """kind-name: lower case, other than letters, digits, underscore, blank and hyphen out, blanks to hyphens, cut."""
    s = F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}_ \\-]", "")), " +", "-"), 1, limit)
    return F.concat(F.lit(kind + "-"), F.when(s == "", F.lit("unknown")).otherwise(s))


def truncated(c: Column, limit: int, marker: str = "...") -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(marker))).otherwise(c)


def human_bytes(n: Column) -> Column:
    """Bytes in units of 1024 with one decimal, which goes if it is 0."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in ((1, " KB"), (2, " MB"), (3, " GB")):
        v = F.format_string("%.1f", F.floor(n / 1024**k * 10 + 0.5) / 10)
        out = F.when(n >= 1024**k, F.concat(F.regexp_replace(v, "\\.0$", ""), F.lit(unit))).otherwise(out)
    return out


def unwrap(c: Column) -> Column:
    """Hard-wrapped paragraphs become single lines; quotes, headings, rules and lists stay as they are."""
    kept = lambda p: p.rlike("^(>|#|---|\\*\\*\\*|- |\\* |[0-9]+\\. )")
    parts = F.transform(F.split(c, "\n\n+"), lambda p: F.when(kept(F.trim(p)), F.trim(p)).otherwise(F.trim(F.regexp_replace(p, "\\s*\n\\s*", " "))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def highlight(c: Column, query: str) -> Column:
    import re

    return F.regexp_replace(c, "(?i)" + re.escape(query), "<mark>$0</mark>") if query else c


def without_markers(c: Column) -> Column:
    """[[TYPE:id|surface]] gives way to its surface."""
    return F.regexp_replace(c, "\\[\\[([A-Z]+):([^|\\]]+)\\|([^\\]]+)\\]\\]", "$3")


def follow_ups(c: Column, separator: str = "---", most: int = 3) -> Column:
    """The first few numbered lines behind the separator."""
    tail = F.when(F.instr(c, separator) > 0, F.substring_index(c, separator, -1))
    return F.slice(F.regexp_extract_all(tail, F.lit("(?m)^[0-9]+[.)] *(.+)$"), 1), 1, most)


def context_rule(c: Column) -> Column:
    """What a transcript line is, first rule first."""
    rules = [("^#", "heading"), ("^(---|\\*\\*\\*)", "rule"), ("(?i)\\[the witness is sworn\\.?\\]", "sworn"), ("^\\*\\*Q\\.?", "question"), ("^\\*\\*A\\.?", "answer"), ("^\\*\\*[^*]+:\\*\\*", "speaker")]
    out = F.lit("text")
    for p, name in reversed(rules):
        out = F.when(c.rlike(p), name).otherwise(out)
    return F.when(F.trim(c) == "", "blank").otherwise(out)


#: Titles that a name loses, in this order, each once.
TITLES = ("^ד[\"״׳']ר\\s+", "^דר\\s+", "^פרופ['׳]?\\s+", "^מר\\s+", "^גב['׳]?\\s+", "^העד\\s+", "^העדה\\s+", "^השופט\\s+")
#: What follows one of these is no part of a name.
NOISE = (" של ", " על ", " את ", " לא ", " אם ", " או ", " כי ", " זה ", " היה ", " טעונה ", " דרושה ", " מיום ", " בנירנברג", " בעניין ", " לקבל ", " נוספת", " בדיקה", " נגבתה")
#: Answers that aren't names.
ANSWERS = ("yes", "no", "i do", "i will", "that is correct")
_WORD = "[\\p{L}\\p{N}_]"


def ocr_repair(c: Column) -> Column:
    """Quotes become plain, one between letters the Hebrew sign; a doubled vav becomes one; white space folds. Null stays null."""
    plain = F.regexp_replace(F.regexp_replace(c, "[״“”]", '"'), "[׳‘’]", "'")
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(plain, f"({_WORD})'({_WORD})", "$1׳$2"), F.lit("וו"), F.lit("ו")), "\\s+", " "))


def without_points(c: Column) -> Column:
    """Hebrew points and quotation marks go, white space folds."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\u0591-\\u05C7\"'״׳]", ""), "\\s+", " "))


def without_titles(c: Column, titles: tuple[str, ...] = TITLES) -> Column:
    return F.trim(reduce(lambda x, p: F.regexp_replace(x, p, ""), titles, F.trim(c)))


def name_key(c: Column) -> Column:
    """Lower case, without an English title."""
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), "^(dr|prof|judge)\\.? +", ""))


def title_if_lower(c: Column) -> Column:
    """Title case for what is wholly lower case; Spark's initcap starts words at blanks alone."""
    return F.when(c == F.lower(c), F.initcap(c)).otherwise(c)


def witness_name(c: Column, strict: bool = False, noise: tuple[str, ...] = NOISE) -> Column:
    """A name as far as the first noise word; null where less than four characters stand before one, where the length
    isn't 3 to 60 (40 if strict) or where no Hebrew letter is left. One pass over the words, so the expression stays short."""
    tail = lambda x: F.trim(F.regexp_replace(F.trim(x), "[.,;:!?()\\[\\]]+$", ""))
    first = F.trim(F.regexp_replace(tail(c), "^העד\\s+", ""))
    cut = lambda x, w: F.when(F.instr(x, w) == 0, x).when(F.instr(x, w) > 4, F.trim(F.left(x, F.instr(x, w) - 1)))
    name = tail(F.aggregate(F.array(*map(F.lit, noise)), first, lambda x, w: cut(x, w)))
    longest = 40 if strict else 60
    return F.when(name.rlike("[\\u0590-\\u05FF]") & F.length(name).between(3, longest), name)


def answered_name(c: Column) -> Column:
    """A name out of an answer: explanations behind a dash, maiden names and dots at the end go; null for an answer without one."""
    steps = [("\\s+", " "), ("\\.+$", ""), ("(?i)\\s*[-–]\\s*(?:my name|originally|née|nee|now|formerly|previously).*", ""), (f"(?i)\\s+(?:née|nee)\\s+{_WORD}+$", ""), ("\\s*[-–]\\s+[a-z].*", "")]
    name = F.trim(replace_all(c, steps))
    return F.when(~F.lower(name).isin(*ANSWERS) & (name != ""), name)


def without_artifacts(c: Column, patterns: tuple[str, ...]) -> Column:
    """Passages by pattern go, over line ends too; repeated rules and blank lines become one."""
    kept = replace_all(c, [("(?is)" + p, "") for p in patterns])
    return stripped(replace_all(kept, [("(\\s*---\\s*\n){2,}", "\n---\n\n"), ("\n{3,}", "\n\n")]))


def transcript_lines(c: Column, header: str, session: str = "^\\s*(?i:session)\\s+(no\\.?\\s*)?[0-9]+\\s*$", shorter: int = 50) -> Column:
    """The lines of a page less page numbers, running heads (short lines with the header) and session lines; quotes plain, blanks folded, empty lines out."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, BIDI, ""))
    kept = F.filter(lines, lambda x: ~x.rlike("^\\s*[0-9]+\\s*$") & ~(F.contains(x, F.lit(header)) & (F.length(x) < shorter)) & ~x.rlike(session))
    folded = F.transform(kept, lambda x: F.trim(F.regexp_replace(F.translate(x, HEBREW_QUOTES, PLAIN_QUOTES), "\\s+", " ")))
    return F.array_join(F.filter(folded, lambda x: x != ""), "\n")


def spaced_marks(c: Column) -> Column:
    """A blank behind a speaker's colon, behind a comma before a letter and behind a full stop before a capital."""
    return replace_all(c, [("(\\*\\*[^*\n]+:\\*\\*)([^\\s*])", "$1 $2"), (",([a-zA-Z])", ", $1"), ("([a-z])\\.([A-Z])", "$1. $2")])


def unfenced(c: Column) -> Column:
    """What a code fence holds, with or without the word json behind it; other text as it is."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "^```(?:json)?\\s*", ""), "\\s*```$", "")


def plain_inline(c: Column) -> Column:
    """Inline Markdown gives way to its text: links, bold, italics, code."""
    return replace_all(c, [("\\[([^\\]\n]+)\\]\\([^)\n]+\\)", "$1"), ("\\*\\*([^*\n]+)\\*\\*", "$1"), ("\\*([^*\n]+)\\*", "$1"), ("`([^`\n]+)`", "$1")])


def escaped(c: Column) -> Column:
    """Text for a page: the five signs of HTML become entities."""
    signs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), signs, c)


def numbered_first(c: Column) -> Column:
    """The number in a name, for ordering; names without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(c, "[0-9]+", 0), F.lit("")).try_cast("long"), F.lit(2**62))


def file_name(c: Column) -> Column:
    """A name that every file system takes: letters, digits, blanks and hyphens stay, blanks become underscores."""
    return F.replace(F.regexp_replace(c, "[^\\p{L}\\p{N}_\\s\\-]", ""), F.lit(" "), F.lit("_"))
