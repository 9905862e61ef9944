"""Column functions of the commerce domain: text, dates, numbers. All are built-in expressions."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.patterns import runs_away

KST_HOURS = 9

#: Endings stripped from title words, the longest that leaves two characters first.
PARTICLES = ("으로부터", "에서부터", "이라는", "라는", "에서", "에게", "으로", "까지", "부터", "보다", "처럼", "마다", "밖에", "이나", "과의", "와의", "의", "가", "이", "은", "는", "을", "를", "에", "도", "만", "로", "와", "과")

#: Words that are no keywords of their own.
STOP_WORDS = ("영상", "브이로그", "블로그", "리뷰", "추천", "방법", "정리", "소개", "공개", "후기", "모음", "특집", "최신", "요즘", "오늘", "이번", "그냥", "진짜", "완전", "너무", "정말", "사람", "우리", "여러분", "구독", "좋아요", "채널", "댓글", "구독자", "라이브", "실시간", "shorts", "vlog", "review", "top", "best", "new", "official", "mv", "ep", "part", "full", "sub", "eng")

#: Patterns that take lot dates and brackets out of item names.
NAME_RULES = {"brackets": r"\([^)]*\)", "date after underscore": r"_\d{2}[.\-/]\d{2}[.\-/]\d{2}$", "date in name": r"\d{2,4}[.\-/]\d{1,2}[.\-/]\d{1,2}"}

#: Patterns that people pick for their own rules.
NAME_PRESETS = {
    "paren": r"\([^)]*\)", "bracket": r"\[[^\]]*\]", "after-underscore": r"_.*$", "date": r"\d{2,4}[.\-/]\d{1,2}[.\-/]\d{1,2}",
    "separator": r"[-_/]+", "size": r"\d+(\.\d+)?\s*(g|kg|ml|l|ea|개|정|포)\b", "pack": r"[xX]\s*\d+\s*(ea|개)?$",
}

#: Texts read as true and false.
TRUE_WORDS, FALSE_WORDS = ("true", "y", "yes", "1", "예"), ("false", "n", "no", "0", "아니오")


# --- text -----------------------------------------------------------------------------------------


def strip_text(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020, tabs and newlines included."""
    return F.trim(c, F.lit("".join(map(chr, range(0x21)))))


def number_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.\-]", "")


def replace_code(c: Column, codes: dict[str, str]) -> Column:
    """Exact dictionary look-up; other values stay."""
    if not codes:
        return c
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def default_if_empty(c: Column, value: str) -> Column:
    return F.when(F.coalesce(strip_text(c), F.lit("")) == "", F.lit(value)).otherwise(c)


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "<[^>]*>", ""))


def normalize_field_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_\-]", ""))


def split_pipes(c: Column) -> Column:
    """Parts between `|`, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def natural_key(*columns: Column) -> Column:
    """Key values joined by U+001F; null if all are blank."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.when(F.concat(*parts) != "", F.concat_ws("\u001f", *parts))


def shorten_key(c: Column, most: int = 100) -> Column:
    """Long keys keep their start and 16 digits of their SHA-256."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 17), F.lit("~"), F.substring(F.sha2(c, 256), 1, 16))).otherwise(c)


def input_hash(ids: Sequence[Column], sources: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in ids], F.array_join(F.array_sort(sources), "|")), 256)


def mask_mentions(c: Column) -> Column:
    return F.regexp_replace(c, r"@[\w가-힣.\-]{2,30}", "@***")


def mask_secrets(values: Column, names: str = r"(?i)(secret|password|token|key)") -> Column:
    """A map with the values of secret-like keys hidden."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(names), F.lit("****")).otherwise(v))


def hangul_share(c: Column) -> Column:
    """Share of Hangul syllables among letters; 0 without letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, r"[^가-힣]", "")) / letters).otherwise(0.0)


def normalize_name(c: Column, rules: Sequence[tuple[str, str]] = tuple((p, "") for p in NAME_RULES.values())) -> Column:
    """Rules one after the other over the first 300 characters, then no white space and lower case; empty for blank names.

    A pattern that does not compile is left out.
    """
    out = F.substring(F.coalesce(c, F.lit("")), 1, 300)
    for pattern, replacement in rules:
        if compiles(pattern):
            out = F.regexp_replace(out, pattern, replacement)
    return F.lower(F.regexp_replace(out, r"\s+", ""))


def changed_by(c: Column, rules: dict[str, tuple[str, str]]) -> Column:
    """Names of the rules that change a value, in order."""
    value, found = F.substring(F.coalesce(c, F.lit("")), 1, 300), []
    for name, (pattern, replacement) in rules.items():
        if compiles(pattern):
            after = F.regexp_replace(value, pattern, replacement)
            found.append(F.when(after != value, F.lit(name)))
            value = after
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


@cache
def compiles(pattern: str) -> bool:
    """Whether a pattern compiles, and no text can make it run away."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return not runs_away(pattern)


def bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column, grams: tuple[Column, Column] | None = None) -> Column:
    """Dice likeness of the bigram sets: 1 for equal texts, 0 for blank or very short ones. `grams` are both bigram sets where they are there already."""
    x, y = grams or (bigrams(a), bigrams(b))
    shared = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    blank = (F.trim(F.coalesce(a, F.lit(""))) == "") | (F.trim(F.coalesce(b, F.lit(""))) == "")
    return F.when(blank, 0.0).when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(shared)


def title_words(c: Column) -> Column:
    """Words of a title: lower case, no plain numbers, no particle at the end, 2 to 12 characters."""
    particle = "|".join(PARTICLES)
    letter = "가-힣ㄱ-ㅎㅏ-ㅣa-z"
    # One pass finds the words that are no plain numbers; it starts at no digit within a run of digits.
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"(?<![0-9])[0-9]*+[{letter}][{letter}0-9]*+"), F.lit(0))
    # Particles are Hangul, so other words need no pattern tried on them. One takes up to four characters off, so longer words stay too long.
    words = F.filter(words, lambda w: F.length(w).between(2, 12 + max(map(len, PARTICLES))))
    words = F.transform(words, lambda w: F.when(F.right(w, F.lit(1)) >= "가", F.regexp_replace(w, f"^(.{{2,}}?)({particle})$", "$1")).otherwise(w))
    return F.filter(words, lambda w: F.length(w) <= 12)


def keywords(c: Column) -> Column:
    """Distinct words but stop words, and pairs of neighbouring words of up to 24 characters."""

    def of(words: Column) -> Column:
        single = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
        pair = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
        return F.array_union(F.array_distinct(single), F.filter(pair, lambda p: F.length(p) <= 24))

    return F.transform(F.array(title_words(c)), of)[0]


def vtt_text(c: Column, most: int = 8000) -> Column:
    """Spoken text of WebVTT captions: no headers, cue times or tags, and no line twice in a row."""
    lines = F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|Kind:|Language:|NOTE)|-->|^\d+$"))
    once = F.filter(kept, lambda x, i: (i == 0) | (x != F.coalesce(F.get(kept, i - 1), F.lit(""))))
    return F.substring(F.array_join(once, " "), 1, most)


#: Full-width signs and letters stand in the same order as ASCII's, at a fixed distance.
_WIDE, _NARROW = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " "


def narrow(c: Column) -> Column:
    """A text with full-width signs, letters and spaces as plain ones: the part of Unicode's compatibility forms that keyboards make."""
    return F.translate(c, _WIDE, _NARROW)


def grounded(quote: Column, *sources: Column) -> Column:
    """Whether a quote of at least 6 characters stands in a source; white space, case and width aside."""
    flat = lambda x: F.lower(F.regexp_replace(narrow(F.coalesce(x, F.lit(""))), r"\s+", ""))
    found = F.lit(False)
    for s in sources:
        found = found | F.contains(flat(s), flat(quote))
    return (F.length(flat(quote)) >= 6) & found


# --- dates ----------------------------------------------------------------------------------------


def to_kst(ts: Column) -> Column:
    """Local time of a UTC time (no daylight saving since 1988)."""
    return ts + F.expr(f"INTERVAL {KST_HOURS} HOURS")


def bucket(ts: Column, granularity: str) -> Column:
    """Start of a UTC time's bucket (DAY, HOUR, TEN_MINUTES, EXACT) by the local calendar, in UTC."""
    back = F.expr(f"INTERVAL {KST_HOURS} HOURS")
    if granularity == "EXACT":
        return ts
    if granularity == "TEN_MINUTES":
        hour = F.date_trunc("hour", ts)
        return F.timestamp_seconds(F.unix_seconds(hour.cast("timestamp")) + F.floor(F.minute(ts) / 10) * 600).cast("timestamp_ntz")
    return F.date_trunc("day" if granularity == "DAY" else "hour", to_kst(ts)).cast("timestamp_ntz") - back


def whole_days(earlier: Column, later: Column) -> Column:
    """Full 24-hour blocks between two times."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    return F.floor((seconds(later) - seconds(earlier)) / 86400)


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts).cast("date")


def parse_date(c: Column) -> Column:
    """ISO date, or the date of an ISO time; null for anything else."""
    plain = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c))
    timed = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.try_to_date(F.substring(c, 1, 10)))
    return F.coalesce(plain, timed)


def parse_time(c: Column, zone: str = "UTC") -> Column:
    """An ISO time with its offset; without one a local time of `zone`, or the start of a local day there; null for anything else."""
    day, clock = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
    c = F.regexp_replace(c, r"T(\d{2}:\d{2})(?=$|Z|[+-])", "T$1:00")  # times with an offset need their seconds
    fixed = F.when(c.rlike(rf"^{day}T{clock}(Z|[+-]\d{{2}}:\d{{2}})$"), c.try_cast("timestamp"))
    local = F.when(c.rlike(rf"^{day}T{clock}$"), F.concat(c, F.lit(f" {zone}")).try_cast("timestamp"))
    return F.coalesce(fixed, local, F.when(c.rlike(rf"^{day}$"), F.concat(c, F.lit(f"T00:00:00 {zone}")).try_cast("timestamp")))


def iso_seconds(c: Column) -> Column:
    """Seconds of an ISO-8601 duration such as PT1H2M3S; -1 if it is none."""
    part = lambda unit: F.coalesce(F.regexp_extract(c, rf"(\d+){unit}", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(c.rlike(r"^P(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?$") & c.rlike(r"\d"), part("D") * 86400 + part("H") * 3600 + part("M") * 60 + part("S")).otherwise(F.lit(-1).cast("bigint"))


def in_quiet_hours(minute_of_day: Column, start: int, end: int) -> Column:
    """Whether a minute of the day is in [start, end), which may pass midnight."""
    return minute_of_day.between(start, end - 1) if start <= end else (minute_of_day >= start) | (minute_of_day < end)


def relative_date(token: str, today: dt.date) -> dt.date:
    """`TODAY`, `TODAY-7`, `오늘+3` or an ISO date."""
    if m := re.fullmatch(r"(?:오늘|TODAY)(?:([+-])(\d{1,5}))?", token.strip(), re.IGNORECASE):
        days = int(m[2] or 0)
        if days > 36_500:
            raise ValueError(f"too far from today: {token}")
        return today + dt.timedelta(days=-days if m[1] == "-" else days)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", token.strip()):
        raise ValueError(f"no date: {token}")
    return dt.date.fromisoformat(token.strip())


# --- numbers --------------------------------------------------------------------------------------


def curve(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear interpolation, clamped at both ends."""
    out = F.when(x <= points[0][0], float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, F.lit(float(y0)) + (y1 - y0) * (x - x0) / (x1 - x0))
    return out.otherwise(float(points[-1][1]))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 1 where b is not positive."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(1.0)


def reach_points(median: Column, low: float, high: float, points: float) -> Column:
    """All points inside [low, high], fewer by the log of the distance outside."""
    r = F.when(median < low, median / low).when(median > high, high / F.when(median > high, median)).otherwise(1.0)
    return F.when(r <= 0, 0.0).otherwise(points * F.greatest(F.lit(0.0), 1 + F.log10(F.when(r > 0, r))))


def grade(total: Column, s: float = 85, a: float = 70, b: float = 55, c: float = 40) -> Column:
    return F.when(total >= s, "S").when(total >= a, "A").when(total >= b, "B").when(total >= c, "C").otherwise("D")


def percent_difference(a: Column, b: Column) -> Column:
    """Difference against the larger side in percent, one decimal; 0 if both are 0."""
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.when(larger == 0, 0.0).otherwise(F.round(100 * F.abs(a - b) / F.when(larger != 0, larger), 1))


def days_left(quantity: Column, average: Column) -> Column:
    return F.when((quantity > 0) & (average > 0), quantity / F.when(average > 0, average))


def typed(c: Column, kind: str, zone: str = "UTC") -> Column:
    """A text as INTEGER, DECIMAL, BOOLEAN, DATE, TIMESTAMP (local ones of `zone`) or STRING; null where it is none."""
    text = strip_text(c)
    if kind == "INTEGER":
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    if kind == "DECIMAL":
        return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.try_cast("decimal(19,6)"))
    if kind == "BOOLEAN":
        return F.when(F.lower(text).isin(*TRUE_WORDS), True).when(F.lower(text).isin(*FALSE_WORDS), False)
    if kind == "DATE":
        return parse_date(text)
    if kind == "TIMESTAMP":
        return parse_time(text, zone)
    return c
