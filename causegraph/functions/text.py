"""Scalar expressions on identifiers, codes and text; all are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Sex codes and their names; others keep their number.
SEX = {1: "male", 2: "female", 9: "unspecified"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def curie(namespace: str, c: Column | str) -> Column:
    """``namespace:identifier``."""
    return F.concat(F.lit(f"{namespace}:"), col(c).cast("string"))


def namespace(c: Column | str) -> Column:
    """Text before the first colon; the whole text without one."""
    return F.substring_index(col(c), ":", 1)


def partition(c: Column | str, sep: str) -> tuple[Column, Column, Column]:
    """(before, found, after) of the first separator; without one: (all, false, '')."""
    c = col(c)
    at = F.instr(c, sep)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c), at > 0, F.when(at > 0, F.substring(c, at + len(sep), F.length(c))).otherwise(F.lit(""))


def lookup(mapping: dict, c: Column | str, default: Column | None = None) -> Column:
    """A literal map's value for c, else the default (NULL without one)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    got = F.try_element_at(F.create_map(*pairs), col(c))
    return got if default is None else F.coalesce(got, default)


def sex_name(c: Column | str) -> Column:
    return lookup(SEX, col(c).cast("int"), col(c).cast("string"))


def icd10_cause(c: Column | str) -> Column:
    """Trimmed; four characters, a letter and then letters or digits, get a dot before the last."""
    t = F.trim(col(c))
    return F.when(t.rlike(r"^\p{L}[\p{L}\p{N}]{3}$"), F.concat(F.substring(t, 1, 3), F.lit("."), F.substring(t, 4, 1))).otherwise(t)


def without_parenthetical(c: Column | str) -> Column:
    return F.trim(F.substring_index(col(c), " (", 1))


def parent_by_dot(c: Column | str) -> Column:
    """Identifier without its last dotted part; NULL without a dot."""
    return F.when(F.contains(col(c), F.lit(".")), F.regexp_replace(col(c), r"\.[^.]*$", ""))


def category(c: Column | str) -> Column:
    """Code before its first dot."""
    return F.substring_index(col(c), ".", 1)


def last_segment(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def tabulation_title(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("- "), F.lit(""))


def question_target(column: str) -> str:
    """A question matrix's column name as the identifier of its category: ``b_0100`` -> 01, ``b_0101`` -> 01.01."""
    code = column[2:]
    return f"who.va:VAs-{code[:-2] if code.endswith('00') else code[:2] + '.' + code[2:]}"


def number(c: Column | str, digits: int = 3) -> Column:
    """Double rounded to ``digits``; NULL for text that is no number, and for NaN."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), F.round(x, digits))


def int_or(c: Column | str, default: int | None = None) -> Column:
    x = col(c).try_cast("double").cast("long")
    return x if default is None else F.coalesce(x, F.lit(default))


def display(name: Column | str, ident: Column | str) -> Column:
    """Trimmed name, or the identifier where the name is null or empty."""
    return F.when(F.coalesce(col(name), F.lit("")) != "", F.trim(col(name))).otherwise(col(ident))


def retrieval_text(concept: Column | str, evidence: Column | str) -> Column:
    """The concept, and below a blank line its evidence, if there is any."""
    joined = F.array_join(col(evidence), " ")
    return F.when(F.size(col(evidence)) > 0, F.concat(col(concept), F.lit("\n\n"), joined)).otherwise(col(concept))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL where b isn't positive."""
    return F.when(col(b) > 0, col(a) / col(b))


def duration(seconds: Column | str) -> Column:
    """``1h 02m 03.4s``, without leading parts that are zero."""
    s = col(seconds)
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600.0)) / 60).cast("int"), F.pmod(s, F.lit(60.0))
    return F.when(h > 0, F.format_string("%dh %02dm %04.1fs", h, m, r)).when(m > 0, F.format_string("%dm %04.1fs", m, r)).otherwise(F.format_string("%.1fs", r))


def language_code(c: Column | str, supported: list[str], aliases: dict[str, str]) -> Column:
    """Lower-cased code through the alias map; NULL if it isn't supported."""
    low = F.lower(F.trim(col(c)))
    got = lookup(aliases, low, low) if aliases else low
    return F.when(got.isin(supported), got)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row, not once for each use in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scoring_text(c: Column | str) -> Column:
    """Lower case, punctuation as spaces, single spaces (Unicode letters and digits stay)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def occurrences(text: Column | str, word: str) -> Column:
    """Non-overlapping occurrences from the left."""
    t = col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(word), F.lit("")))) / len(word)).cast("long")


def mentions(text: Column | str, words: list[str]) -> Column:
    out = F.lit(0).cast("long")
    for w in words:
        out = out + occurrences(text, w)
    return out


def positional_join(columns: list[Column], sep: str = ";") -> Column:
    """Joined with empty places for nulls, so positions stay."""
    return F.array_join(F.array(*[c.cast("string") for c in columns]), sep, "")


def year_map(columns: list[str]) -> Column:
    """{year: value} of columns whose name begins with four digits; cells that are no number are left out."""
    years = [c for c in columns if c[:4].isdigit() and len(c) >= 4]
    entries = F.array(*[F.struct(F.lit(c[:4]).alias("key"), number(F.col(f"`{c}`")).alias("value")) for c in years])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def epoch(seconds: Column | str) -> Column:
    """Timestamp of Unix seconds given as a double."""
    return F.timestamp_micros((col(seconds) * 1_000_000).cast("long"))


def spoken_text(segments: Column, language: Column | str, raw: Column | str, limit: float = 0.6, other_limit: float = 0.8) -> Column:
    """Text of the segments (array of struct<text, no_speech_prob>) that are likely speech, joined as they are;
    the raw text where there are no segments."""
    most = F.when(col(language) == "en", F.lit(limit)).otherwise(F.lit(max(limit, other_limit)))
    kept = F.array_join(F.transform(F.filter(segments, lambda s: s["no_speech_prob"] < most), lambda s: s["text"]), "")
    return F.trim(F.when(F.size(segments) > 0, kept).otherwise(col(raw)))


def silent(peak: Column | str, integer: bool = False) -> Column:
    """True below the silence gate: 0.001 for floats, 33 for 16-bit samples."""
    return col(peak) < (33 if integer else 0.001)


def stable_id(*parts: Column | str) -> Column:
    """An id in the shape of a UUID that depends on the parts alone, so a task that runs again makes the same one."""
    h = F.md5(F.concat_ws("\x1f", *[col(p).cast("string") for p in parts]).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
