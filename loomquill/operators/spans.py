"""Spans of testimony in transcripts: where they start and end, whose they are, whether anyone else speaks in them.

Texts are cut by expressions within a row; rules over lines are window functions per document and equi-joins on it.
A document's lines are ordered by one task, so a document must fit one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import answered_name, stripped

_NAME = "[A-Z][a-zA-Z\\-]+"
#: How transcripts say that a witness is sworn in, in this order.
SWORN = (
    "\\[\\s*[Tt]he witness is sworn[^\\]]*\\]", "\\[\\s*[Tt]he witness was sworn[^\\]]*\\]", "\\[\\s*[Tt]he witness makes (?:an |his )?affirmation[^\\]]*\\]",
    "\\[\\s*[Ww]itness is sworn[^\\]]*\\]", "\\[\\s*[Ww]itness was sworn[^\\]]*\\]", "\\[\\s*[Ww]itness makes (?:an |his )?affirmation[^\\]]*\\]",
    f"\\[\\s*[Ww]itness\\s+{_NAME}\\s+is sworn[^\\]]*\\]", f"\\[\\s*[Ww]itness\\s+{_NAME}\\s+was sworn[^\\]]*\\]",
    f"\\[\\s*(?:Mr\\.|Mrs\\.|Dr\\.)\\s*{_NAME}\\s+is sworn[^\\]]*\\]", f"\\[\\s*(?:Mr\\.|Mrs\\.|Dr\\.)\\s*{_NAME}\\s+was sworn[^\\]]*\\]",
    "\\[\\s*[Tt]he witness affirms[^\\]]*\\]", "\\[\\s*[Ww]itness affirms[^\\]]*\\]",
    "(?:^|\n)The witness is sworn\\.(?:\\s*\n)", "(?:^|\n)The witness was sworn\\.(?:\\s*\n)", "(?:^|\n)The witness affirms\\.(?:\\s*\n)", "(?:^|\n)Witness affirms\\.(?:\\s*\n)", "(?:^|\n)Witness is sworn\\.(?:\\s*\n)",
)
_CONCLUDED = "(?:you have concluded your testimony|Thank you.*?you have concluded)"
#: How a testimony ends; the first pattern that is found counts.
ENDS = ("\\*\\*Presiding Judge:\\*\\*.*?" + _CONCLUDED, "\\*\\*Presiding Judge:\\*\\*.*?Thank you,? (?:Mr\\.|Mrs\\.|Dr\\.|Miss).*?\\.(?:\\s*\n)")
_FULL = "([A-Z][a-zA-Z\\s\\-']+(?:\\s+[A-Z][a-zA-Z\\-']+)+)"
_DOCTOR = "(Dr\\.\\s+[A-Z][a-zA-Z]+\\s+[A-Z][a-zA-Z\\s\\-']+)"
_WHO = "(?:Your (?:full |first )?name\\?|What is (?:your|his|her) (?:full |first )?name\\?)[^\\*]*\\*\\*(?:Witness[^\\*]*|A)\\.?\\*\\*:?\\s*(?:My name is\\s+)?"
#: Where a witness is named, with the number of characters that are looked at.
NAMED = (
    ("\\*\\*Witness:\\*\\*\\s*(?:My name is\\s+)?(?:Dr\\.\\s+|Prof\\.\\s+|Mr\\.\\s+|Mrs\\.\\s+)?" + _FULL + "[\\.\\s]", 1500),
    ("\\*\\*Witness:\\*\\*\\s*(?:My name is\\s+)?" + _DOCTOR, 1500),
    (_WHO + "(?:Dr\\.\\s+|Prof\\.\\s+)?" + _FULL, 2000),
    (_WHO.removesuffix("(?:My name is\\s+)?") + _DOCTOR, 2000),
    ("\\*\\*Witness\\s+([A-Z][a-zA-Z\\.\\s\\-']+?):\\*\\*", 2000),
)
#: Fixed value: how a witness is called before being sworn, in the characters before it.
CALLED, BEFORE = "I (?:now )?call(?:\\s+(?:the\\s+)?witness)?\\s+(?:Mr\\.\\s+|Mrs\\.\\s+|Dr\\.\\s+|Prof\\.\\s+)?([A-Z][a-zA-Z\\.\\s\\-']+?)(?:\\.|,|\n)", 500


def between_markers(docs: DataFrame, patterns: tuple[str, ...] = SWORN, before: int = BEFORE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, span, start, text, lead): the text behind each marker up to the next one or the end, and what stands before the marker.

    Spans count from 0; start is the place of the marker. Documents without a marker give no row. Nothing is shuffled.
    """
    either = "(?i)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    parts = F.split(text, either)
    marks = F.regexp_extract_all(text, F.lit(f"({either})"), 1)
    lengths = lambda a: F.transform(a, F.length)
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    rows = docs.select(key, text, parts.alias("_p"), marks.alias("_m")).where(F.size("_m") > 0)
    rows = rows.select(key, text, "_p", "_m", F.posexplode(F.slice("_p", 2, F.size("_m"))).alias("span", "_t"))
    start = total(lengths(F.slice("_p", 1, F.col("span") + 1))) + F.when(F.col("span") > 0, total(lengths(F.slice("_m", F.lit(1), F.col("span"))))).otherwise(0)
    rows = rows.withColumn("start", start)
    lead = F.substring(F.col(text), F.greatest(F.col("start") - before, F.lit(0)) + 1, F.least(F.col("start"), F.lit(before)))
    return rows.select(key, "span", "start", F.col("_t").alias("text"), lead.alias("lead"))


def ended(c: Column, patterns: tuple[str, ...] = ENDS) -> Column:
    """The text through the first pattern, in their order, that it has; else all of it."""
    found = [F.nullif(F.regexp_extract(c, "(?is)^.*?" + p, 0), F.lit("")) for p in patterns]
    return F.coalesce(*found, c)


def named(c: Column, lead: Column, patterns: tuple[tuple[str, int], ...] = NAMED, called: str = CALLED) -> Column:
    """The name that the first pattern finds in the beginning of a testimony, else the last resort in what stands before it."""
    found = [F.nullif(F.trim(F.regexp_extract(F.left(c, F.lit(n)), p, 1)), F.lit("")) for p, n in patterns]
    return F.coalesce(*found, F.nullif(F.trim(F.regexp_extract(lead, called, 1)), F.lit("")))


def testimonies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, span, name, text) of the testimonies whose witness is named."""
    rows = between_markers(docs, key=key, text=text).withColumn("text", ended(F.col("text")))
    return rows.select(key, "span", answered_name(named(F.col("text"), F.col("lead"))).alias("name"), stripped(F.col("text")).alias("text")).where("name is not null")


@dataclass(frozen=True)
class Marks:
    """The phrases that start and end Hebrew testimonies, and the guards, in lines behind the start."""

    sworn: tuple[str, ...] = ("העד הושבע", "העדה הושבעה", "העד מצהיר", "העדה מצהירה")
    declared: tuple[str, ...] = ("הצהיר בהן צדק", "הצהירה בהן צדק")
    thanks: str = "תודה"
    judge: tuple[str, ...] = ("אב בית הדין", "השופט")
    dismissed: tuple[str, ...] = ("סיימת את עדותך", "סיימת את עדות", "גמרת את עדותך", "גמרת את עדות", "בזה סיימת", "בזה גמרת")
    speaks: str = "הע[דה] ([^\\s,.:]+)"
    speaker: tuple[str, ...] = ("העד", "העדה")
    calls: tuple[str, ...] = ("אני קורא ל", "אני קורא את")
    addressed: tuple[str, ...] = ("גברת", "מר ", "דר")
    ahead: int = 15
    after_sworn: int = 10
    first: int = 10
    other: int = 50
    called: int = 30
    least: int = 500


def has(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases])


def any_of(c: Column, names: Column) -> Column:
    return F.exists(names, lambda n: F.contains(c, n))


def _ahead(lines: DataFrame, n: int, name: str, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, n - 1)
    return lines.withColumn(name, F.array_join(F.collect_list("line").over(w), "\n"))


def starts(lines: DataFrame, witnesses: DataFrame, marks: Marks = Marks(), key: str = "doc_id") -> DataFrame:
    """(key, witness, start): the first marker of a document with a variant of the witness's name in the lines from it on.

    witnesses: (witness, variants, others). Only marker lines meet the witnesses, and those by one broadcast of their table,
    which must be small; lines: (key, line_no, line).
    """
    found = _ahead(lines, marks.ahead, "_near", key).where(has(F.col("line"), (*marks.sworn, *marks.declared))).select(key, "line_no", "_near")
    met = found.join(F.broadcast(witnesses.select("witness", "variants")), any_of(F.col("_near"), F.col("variants")))
    return met.groupBy(key, "witness").agg(F.min("line_no").alias("start"))


def ends(lines: DataFrame, begun: DataFrame, witnesses: DataFrame, marks: Marks = Marks(), key: str = "doc_id") -> DataFrame:
    """(key, witness, start, end, rule): the first line some way behind the start at which a rule holds.

    1 the judge thanks the witness by name or says that the testimony is over; the line is the last one. 2 another witness is sworn; 3 another
    one speaks at a line's begin; 4 the next one is called: the line before is the last one. 0: the document's end.
    """
    rows = _ahead(lines, marks.after_sworn, "_near", key)
    j = rows.join(begun.join(F.broadcast(witnesses), "witness"), key).where(F.col("line_no") >= F.col("start") + marks.first)
    line, behind = F.col("line"), F.col("line_no") - F.col("start")
    own = any_of(line, F.col("variants"))
    speaks = F.regexp_extract(line, marks.speaks, 1)
    over = own & ((F.contains(line, F.lit(marks.thanks)) & has(line, marks.judge)) | has(line, marks.dismissed))
    sworn = has(line, marks.sworn) & (behind > marks.other) & ~any_of(F.col("_near"), F.col("variants"))
    begins = reduce(lambda a, b: a | b, [F.startswith(F.trim(line), F.lit(p)) for p in marks.speaker])
    other = ~F.array_contains("variants", speaks) & F.array_contains("others", speaks) & begins & (behind > marks.other)
    called = has(line, marks.calls) & ~own & (behind > marks.called)
    rule = F.when(over, 1).when(sworn, 2).when(other, 3).when(called, 4)
    first = j.withColumn("rule", rule).where("rule is not null").groupBy(key, "witness", "start").agg(F.min_by("rule", "line_no").alias("rule"), F.min("line_no").alias("_l"))
    last = lines.groupBy(key).agg(F.max("line_no").alias("_z"))
    out = begun.join(first, [key, "witness", "start"], "left").join(last, key)
    end = F.when(F.col("rule").isNull(), F.col("_z")).when(F.col("rule") == 1, F.col("_l")).otherwise(F.col("_l") - 1)
    return out.select(key, "witness", "start", end.alias("end"), F.coalesce("rule", F.lit(0)).alias("rule"))


def issues(lines: DataFrame, spans: DataFrame, witnesses: DataFrame, marks: Marks = Marks(), key: str = "doc_id") -> DataFrame:
    """(key, witness, line_no, kind, name): lines of a span in which another witness speaks or is thanked."""
    j = lines.join(spans.join(F.broadcast(witnesses), "witness"), key).where(F.col("line_no").between(F.col("start"), F.col("end")))
    line, speaks = F.col("line"), F.regexp_extract(F.col("line"), marks.speaks, 1)
    spoken = F.when(F.array_contains("others", speaks) & ~F.array_contains("variants", speaks), F.array(speaks)).otherwise(F.array().cast("array<string>"))
    thanked = F.when(F.contains(line, F.lit(marks.thanks)) & has(line, marks.addressed), F.filter(F.array_except("others", "variants"), lambda n: F.contains(line, n))).otherwise(F.array().cast("array<string>"))
    named_ = lambda a, kind: F.transform(a, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    return j.select(key, "witness", "line_no", F.explode(F.concat(named_(spoken, "speaks"), named_(thanked, "thanked"))).alias("x")).select(key, "witness", "line_no", "x.kind", "x.name")


def pure_spans(lines: DataFrame, spans: DataFrame, witnesses: DataFrame, marks: Marks = Marks(), key: str = "doc_id") -> DataFrame:
    """(key, witness, start, end, n_chars, n_issues): spans cut before their first issue, looked at again; short ones go."""
    found = issues(lines, spans, witnesses, marks, key).groupBy(key, "witness").agg(F.min("line_no").alias("_i"))
    cut = spans.join(found, [key, "witness"], "left").withColumn("end", F.when(F.col("_i").isNull(), F.col("end")).otherwise(F.col("_i") - 1)).drop("_i")
    left = issues(lines, cut, witnesses, marks, key).groupBy(key, "witness").agg(F.count("*").alias("n_issues"))
    size = lines.join(cut.select(key, "witness", "start", "end"), key).where(F.col("line_no").between(F.col("start"), F.col("end")))
    size = size.groupBy(key, "witness").agg((F.sum(F.length("line")) + F.count("*") - 1).alias("n_chars"))
    out = cut.join(size, [key, "witness"]).join(left, [key, "witness"], "left").where(F.col("n_chars") >= marks.least)
    return out.select(key, "witness", "start", "end", "n_chars", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def sworn_spans(lines: DataFrame, sworn: Column, name: Column, over: Column, back: int = 10, within: int = 2000, key: str = "doc_id") -> DataFrame:
    """(key, name, start, end): from each marker whose witness is named in the lines before it, the nearest first, to the line
    before the next such marker, or to the first line that ends it, if that comes within some lines."""
    w = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("_name", F.nullif(name, F.lit("")))
    marked = marked.withColumn("_who", F.last("_name", ignorenulls=True).over(w.rowsBetween(-back, -1))).withColumn("_over", over)
    begun = marked.withColumn("_begins", F.when(sworn & F.col("_who").isNotNull(), F.col("line_no")))
    begun = begun.withColumn("_span", F.last("_begins", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_span is not null")
    near = F.when(F.col("_over") & (F.col("line_no") > F.col("_span")) & (F.col("line_no") <= F.col("_span") + within), F.col("line_no"))
    return begun.groupBy(key, F.col("_span").alias("start")).agg(F.min_by("_who", "line_no").alias("name"), F.coalesce(F.min(near), F.max("line_no")).alias("end"))


def mention_spans(lines: DataFrame, names: DataFrame, marker: Column, asks: Column, over: Column, stops: Column, around: int = 50, asked: int = 20, after: int = 100, tail: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, witness, start, end) about the mentions of a witness in a document.

    It starts at the nearest marker within `around` lines of the first mention, else at the nearest question for a name
    within `asked`, else at the mention; it ends at the first dismissal up to `after` lines behind the last mention, else before
    the next marker or session within `around` lines of it, else there; and has `tail` lines more. names: (witness, variants), small.
    """
    flagged = lines.withColumns({"_m": marker, "_a": asks, "_o": over, "_s": stops})
    hits = flagged.join(F.broadcast(names), any_of(F.col("line"), F.col("variants"))).groupBy(key, "witness").agg(F.min("line_no").alias("_f"), F.max("line_no").alias("_l"))
    j = flagged.where("_m or _a or _o or _s").join(hits, key)
    n, f, last = F.col("line_no"), F.col("_f"), F.col("_l")
    nearest = lambda when: F.min_by(F.when(when, n), F.when(when, F.struct(F.abs(n - f), n)))
    found = j.groupBy(key, "witness").agg(nearest(F.col("_m") & (F.abs(n - f) <= around)).alias("_marker"), nearest(F.col("_a") & (F.abs(n - f) <= asked)).alias("_ask"), F.min(F.when(F.col("_o") & (n > f) & (n <= last + after), n)).alias("_over"), F.min(F.when((F.col("_m") | F.col("_s")) & (n > last) & (n <= last + around), n)).alias("_stop"))
    size = lines.groupBy(key).agg(F.max("line_no").alias("_z"))
    out = hits.join(found, [key, "witness"], "left").join(size, key)
    end = F.coalesce("_over", F.col("_stop") - 1, "_l")
    return out.select(key, "witness", F.coalesce("_marker", "_ask", "_f").alias("start"), F.least(end + tail, "_z").alias("end"))


def source_spans(sources: DataFrame, before: int = 100, after: int = 500, key: str = "doc_id") -> DataFrame:
    """(key, witness, start, end): from the least start to the greatest end of a witness's sources, widened for the search."""
    out = sources.groupBy(key, "witness").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return out.select(key, "witness", F.greatest(F.col("start") - before, F.lit(0)).alias("start"), (F.col("end") + after).alias("end"))


def line_range(lines: DataFrame, ranges: DataFrame, range_: str, around: int = 0, key: str = "doc_id") -> DataFrame:
    """(key, range, text): lines of "start-end", counted from 1, both included, and some lines around; a range that isn't two numbers gives none."""
    ab = F.split(range_, "-")
    r = ranges.select(key, F.col(range_).alias("range"), (ab[0].try_cast("int") - 1 - around).alias("_a"), (F.get(ab, 1).try_cast("int") - 1 + around).alias("_b"))
    met = lines.join(r, key).where(F.col("line_no").between(F.col("_a"), F.col("_b")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return met.groupBy(key, "range").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def relabelled(line: Column, labels: list[tuple[str, str]]) -> Column:
    """A line with the first prefix that it has, by pattern, written in its label's form."""
    out = line
    for pattern, label in reversed(labels):
        out = F.when(line.rlike("^" + pattern), F.concat(F.lit(label + " "), F.trim(F.regexp_replace(line, "^" + pattern, "")))).otherwise(out)
    return out


def tagged(lines: DataFrame, rules: list[tuple[str, str]], session: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, line_no, session, tag): the first rule's tag of each line that has one; with a pattern, the number that the last session line had."""
    tag = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        tag = F.when(F.col("line").rlike(pattern), name).otherwise(tag)
    rows = lines.withColumn("tag", tag)
    if session is None:
        return rows.where("tag is not null").select(key, "line_no", F.lit(None).cast("int").alias("session"), "tag")
    number = F.nullif(F.regexp_extract("line", session, 1), F.lit("")).try_cast("int")
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("session", F.last(number, ignorenulls=True).over(w)).where("tag is not null").select(key, "line_no", "session", "tag")


def anchored(text: Column, segments: Column) -> Column:
    """The text's slices [start, end) of an array of structs, one behind the other."""
    return F.array_join(F.transform(segments, lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"])), "")


def page_ranges(docs: DataFrame, pages: str, size: int = 15) -> DataFrame:
    """docs with (first, last) page of each part of so many pages; a document without pages gives no row."""
    starts_ = F.when(F.col(pages) > 0, F.sequence(F.lit(1), F.col(pages).cast("int"), F.lit(size)))
    return docs.withColumn("first", F.explode(starts_)).withColumn("last", F.least(F.col("first") + size - 1, F.col(pages).cast("int")))
