"""Readings from free-text model answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases by which an answer says that there is no number.
NO_NUMBER = ("no number", "not visible", "cannot see", "unclear", "no jersey", "can't see", "unable", "none", "n/a")


def shirt_number(answer: Column) -> Column:
    """The first whole one- or two-digit number from 1 to 99 in an answer; null where it says there is none."""
    low = F.lower(F.trim(answer))
    denied = F.lit(False)
    for phrase in NO_NUMBER:
        denied = denied | low.contains(phrase)
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"\b([0-9]{1,2})\b"), F.lit(1)), lambda n: n.cast("int"))
    return F.when(~denied, F.get(F.filter(numbers, lambda n: n.between(1, 99)), F.lit(0)))


#: Characters that a reader takes for digits.
LOOKALIKES = {
    "一": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9", "〇": "0", "零": "0", "公": "8", "本": "8",
    "O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "Z": "2", "z": "2", "B": "8", "S": "5", "s": "5", "T": "7",
}


def digits_read(text: Column) -> Column:
    """The digits of a reading, with characters that look like one taken for it and others dropped."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "".join(LOOKALIKES), "".join(LOOKALIKES.values())), "[^0-9]", "")


def best_reading(readings: Column, min_score: float = 0.5) -> Column:
    """struct<number, score> of the best of array<struct<text, score>>: one or two digits from 1 to 99; of equal scores the first; null where there is none."""
    read = F.transform(readings, lambda r, i: F.struct(r["score"].alias("score"), (-i).alias("back"), digits_read(r["text"]).alias("digits")))
    good = F.filter(read, lambda r: (r["score"] >= min_score) & r["digits"].rlike("^[0-9]{1,2}$") & r["digits"].cast("int").between(1, 99))
    best = F.array_max(good)
    return F.when(F.size(good) > 0, F.struct(best["digits"].cast("int").alias("number"), best["score"].alias("score")))


def json_reading(answer: Column) -> Column:
    """struct<reading, confidence, visible> of an answer that holds a JSON object; other answers are read as shirt_number() does, with confidence 0.5."""
    text = F.trim(answer)
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    whole = F.when(found != "", F.try_parse_json(found))
    field = lambda name: F.try_variant_get(whole, f"$.{name}", "string")
    number = F.expr("try_cast(NULL AS INT)")
    number = F.when(field("reading").rlike("^ *[+-]?[0-9]+ *$"), field("reading").try_cast("int")).otherwise(number)
    number = F.when(number.between(1, 99), number)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(field("crop_confidence").try_cast("double"), F.lit(0.0))))
    plain = shirt_number(text)
    read = F.struct(number.alias("reading"), F.when(number.isNull(), F.lit(0.0)).otherwise(sure).alias("confidence"), F.substring(F.coalesce(field("visible_digits"), F.lit("")), 1, 80).alias("visible"))
    return F.when(whole.isNotNull(), read).otherwise(F.struct(plain.alias("reading"), F.when(plain.isNull(), 0.0).otherwise(0.5).alias("confidence"), F.substring(text, 1, 80).alias("visible")))


def shows_a_back(label: Column) -> Column:
    """Does a verdict say that a number is seen, at least in part?"""
    return F.coalesce(label, F.lit("")).rlike("^(partial: )?[0-9]")


def clock(seconds: Column) -> Column:
    """mm:ss.ss; negative times count as zero."""
    s = F.greatest(F.lit(0.0), seconds)
    minutes = F.floor(s / 60)
    return F.format_string("%02d:%05.2f", minutes, s - minutes * 60)


def highlight_title(stem: Column) -> Column:
    """'goal_434_right' as 'Goal · frame 434 · right'; a stem without a frame with spaces for underscores."""
    parts = F.split(stem, "_")
    kind = F.concat(F.upper(F.substring(parts[0], 1, 1)), F.lower(F.substring(parts[0], 2, 1 << 20)))
    rest = F.array_join(F.slice(parts, 3, 1 << 20), " ")
    title = F.concat(kind, F.lit(" · frame "), F.get(parts, F.lit(1)))
    return F.when(F.get(parts, F.lit(1)).rlike("^[0-9]+$"), F.when(rest == "", title).otherwise(F.concat(title, F.lit(" · "), rest))).otherwise(F.replace(stem, F.lit("_"), F.lit(" ")))


def safe_name(name: Column) -> Column:
    """A file name: all but letters, digits, dot, underscore and hyphen become underscores."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def player_label(team: Column, number: Column, role: Column, ordinal: Column) -> Column:
    """'A-9', 'A-GK' or 'A-unk-01'."""
    side = F.when(team.startswith("team_"), F.substring(team, 6, 1 << 20)).otherwise(team)
    end = F.when((role == "goalkeeper") & number.isNull(), "GK").when(number.isNotNull(), number.cast("string")).otherwise(F.format_string("unk-%02d", ordinal))
    return F.concat(side, F.lit("-"), end)
