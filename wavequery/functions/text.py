"""Free-text answers to typed columns, as Catalyst expressions only.

A bad answer is a miss, never an error: casts are ``try_cast``, array access is
``get``.  No match is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of answers, and the words that carry no meaning.
TIMESTAMP = r"(\d{1,2}:\d{2}(?:\.\d+)?)"
PRECEDING = r"[Pp]receding\s+sound[:\s]+([^.\n]+)"
SOUND_OR_WAS = r"(?i)(?:sound|was)[:\s]+([^.\n]+)"
SPEAKER = r"[Ss]peaker[:\s]+(\d+)"
FIRST_APPEARANCE = r"[Ff]irst\s+appearance[:\s]+([^\.\n]+)"
EVENT_LINE = r"(?i)Event[:\s]+([^,]+),\s*Start[:\s]+([^,]+),\s*End[:\s]+([^,]+)(?:,\s*Overlaps[:\s]+(.*))?"
NUMBERED_LINE = r"(\d+)[\.\:\)]\s*([^,]+)[,\;]\s*([^,]+)[,\;]\s*([^,]+)"
#: The same over a whole line, from its first match on, with the cells as lines; what begins with a line's end has cells already.
EVENT_CELLS = (rf"\A(?s:.*?){EVENT_LINE}(?s:.*)\z", "\n$1\n$2\n$3\n$4")
NUMBERED_CELLS = (rf"\A(?!\n)(?s:.*?){NUMBERED_LINE}(?s:.*)\z", "\n$2\n$3\n$4\n")
VERDICT = r"(?i)verdict[:\s]+(Validates|Debunks|Inconclusive)"
STEP = r"[Ss]tep\s+\d+[:\s]+"
#: Minutes and seconds with white space around them, whatever follows a second colon.
MINUTES_SECONDS = r"^(?U:\s*)([+-]?\d+)(?U:\s*):(?U:\s*)([+-]?(?:\d+(?:\.\d*)?|\.\d+))(?U:\s*)(?::|\z)"
#: White space of Unicode.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "is", "was", "at", "in", "on", "to", "for", "of", "with", "by"]


def strip(c: Column) -> Column:
    """Without white space at both ends (Unicode, like Python)."""
    return F.trim(c, F.lit(WHITE))


def words(c: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\S+"), F.lit(0))


def tokens(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(words(c))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL without one; a match may be empty."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def seconds(ts: Column) -> Column:
    """MM:SS[.f] to seconds; NULL if it is none.  A third part is ignored.
    Digits around one colon, as nearly all are, are read without a pattern."""

    def of(minutes: Column, secs: Column) -> Column:
        return minutes.try_cast("bigint") * F.lit(60) + secs.try_cast("double")

    plain = of(F.substring_index(ts, ":", 1), F.substring_index(ts, ":", -1))
    return F.when(F.translate(ts, "0123456789", "") == ":", plain).otherwise(of(*(F.regexp_extract(ts, MINUTES_SECONDS, g) for g in (1, 2))))


def seconds_or_zero(ts: Column) -> Column:
    return F.coalesce(seconds(ts), F.lit(0.0))


def mmss(s: Column) -> Column:
    """Seconds to MM:SS, both floored; minutes may pass 99."""
    return F.when(s.isNotNull(), F.format_string("%02d:%02d", F.floor(s / 60), F.floor(s % 60)))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of word sets; 0 if either has none."""
    x, y = tokens(a), tokens(b)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return F.coalesce(F.when(some, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))), F.lit(0.0))


def anih_answer(c: Column) -> Column:
    """struct<timestamp, preceding_sound>."""
    sound = F.coalesce(strip(found(c, PRECEDING)), strip(found(c, SOUND_OR_WAS)))
    return F.struct(found(c, TIMESTAMP).alias("timestamp"), sound.alias("preceding_sound"))


def drift_answer(c: Column) -> Column:
    """struct<predicted_speaker, first_appearance>."""
    first = strip(found(c, FIRST_APPEARANCE))
    return F.struct(
        found(c, SPEAKER).try_cast("int").alias("predicted_speaker"),
        F.when(~F.lower(first).isin("never", "none", "n/a"), first).alias("first_appearance"),
    )


def soundscape_answer(c: Column) -> Column:
    """array<struct<event_type, start, end, overlaps>>, in order of lines.

    A pattern runs once a line: it puts a line's cells on lines of their own,
    since a line holds no line's end."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    cells = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, *EVENT_CELLS), *NUMBERED_CELLS))
    cells = F.transform(F.filter(cells, lambda x: F.startswith(x, F.lit("\n"))), lambda x: F.split(x, "\n"))
    names = ("event_type", "start", "end", "overlaps")
    events = F.transform(cells, lambda x: F.struct(*[strip(F.get(x, i)).alias(n) for i, n in enumerate(names, 1)]))
    return F.coalesce(events, F.array().cast("array<struct<event_type:string,start:string,end:string,overlaps:string>>"))


def narrative_answer(c: Column) -> Column:
    """struct<verdict, reasoning_steps, cited_timestamps>."""
    parts = F.split(c, STEP)
    steps = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda x: F.regexp_replace(strip(x), r"\.+$", ""))
    word = found(c, VERDICT)  # of A-Z alone, so its case needs no tables
    return F.struct(
        F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 20))).alias("verdict"),
        F.filter(steps, lambda x: x != "").alias("reasoning_steps"),
        F.regexp_extract_all(c, F.lit(TIMESTAMP), F.lit(1)).alias("cited_timestamps"),
    )


def step_words(c: Column) -> Column:
    """Distinct words, stop words aside."""
    return F.array_except(words(c), F.array(*[F.lit(w) for w in STOP_WORDS]))


def step_matches(predicted: Column, true: Column) -> Column:
    """At least 30 % of the true step's ``step_words`` are there, among the
    ``words`` of the predicted one."""
    hit = F.size(F.array_intersect(predicted, true)) / F.size(true) >= 0.3
    return F.when(F.size(true) > 0, hit).otherwise(False)


def title(c: Column) -> Column:
    """A name for display."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
