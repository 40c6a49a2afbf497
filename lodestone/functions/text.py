"""Text keys, tokens and small parsers as Column builders; all stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space; neither engine's \s means it.
BLANK = r"[\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same characters by one property, which the JVM's expressions test several times faster than the ranges.
WHITE = r"\p{IsWhite_Space}"
# Blanks beside these marks do not count in titles.
TITLE_MARKS = "[—–：:，,；;。！!？?（()）“”「」《》]"
TOKEN = r"[a-z0-9]+(?:[+._/-][a-z0-9]+)*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.btrim(F.regexp_replace(_col(c), f"{WHITE}+", " "), F.lit(" "))


def normalize(c: Column | str) -> Column:
    return F.lower(clean(c))


def title_key(c: Column | str) -> Column:
    """Normalised title without blanks beside punctuation; C++, C# and 1.2 keep theirs.

    Blanks stand alone after normalize(), so each is looked at once, and marks are looked for beside blanks only.
    """
    return F.regexp_replace(normalize(c), f" (?:(?={TITLE_MARKS})|(?<={TITLE_MARKS} ))", "")


def source_key(c: Column | str) -> Column:
    """Normalised source name without closing dots, full-width brackets made plain."""
    return F.translate(normalize(F.rtrim(clean(c), F.lit(" .。"))), "（）", "()")


def doi_key(c: Column | str) -> Column:
    low = F.lower(clean(c))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        low = F.when(F.startswith(low, F.lit(prefix)), F.substr(low, F.lit(len(prefix) + 1))).otherwise(low)
    return low


def native_key(dbname: Column | str, filename: Column | str) -> Column:
    """Empty unless both parts are known."""
    a, b = F.coalesce(_col(dbname), F.lit("")), F.coalesce(_col(filename), F.lit(""))
    return F.when((a == "") | (b == ""), "").otherwise(F.upper(F.concat_ws(":", a, b)))


def json_string(c: Column | str) -> Column:
    """The JSON string of a text, with the characters escaped that are unsafe in HTML."""
    out = F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    odd = out
    for code in (*range(32), 0x3C, 0x3E, 0x26, 0x2028, 0x2029):
        odd = F.replace(odd, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1F<>&\x{2028}\x{2029}]"), odd).otherwise(out), F.lit('"'))


def bibliography_key(title: Column | str, authors: Column | str, source: Column | str, year: Column | str, known: Column | None = None) -> Column:
    """SHA-256 of the JSON array of title key, authors, source and year; empty if one is missing. known: the title key, where a column has it."""
    t, a, s, y = map(_col, (title, authors, source, year))
    missing = (F.coalesce(t, F.lit("")) == "") | (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(s, F.lit("")) == "") | (F.coalesce(y, F.lit(0)) == 0)
    return F.when(missing, "").otherwise(F.sha2(F.concat(F.lit("["), F.concat_ws(",", json_string(title_key(t) if known is None else known), json_string(normalize(F.array_join(a, "|"))), json_string(normalize(s)), y.cast("string")), F.lit("]")), 256))


def record_ref(key: Column | str) -> Column:
    """Stable reference from the strongest key."""
    return F.concat(F.lit("cr_"), F.substr(F.sha2(json_string(key), 256), F.lit(1), F.lit(16)))


def latin_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN), F.lit(0)))


def han_bigrams(c: Column | str) -> Column:
    """Neighbouring Han characters; one alone gives none."""
    chars = F.filter(F.split(_col(c), ""), lambda x: x != "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.when(a.rlike(r"\p{IsHan}") & b.rlike(r"\p{IsHan}"), F.concat(a, b)))
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def tokens(c: Column | str) -> Column:
    """Latin tokens and Han bigrams; the second only where there is a Han character."""
    c = _col(c)
    return F.when(c.rlike(r"\p{IsHan}"), F.array_union(latin_tokens(c), han_bigrams(c))).otherwise(latin_tokens(c))


def dice(a: Column | str, b: Column | str) -> Column:
    """Overlap of two token sets, 0 if one is empty."""
    a, b = _col(a), _col(b)
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def concept_coverage(text: Column, groups: list[list[str]]) -> Column:
    """Share of the groups of which one term is part of the normalised text."""
    if not groups:
        return F.lit(0.0)
    hit = [reduce(lambda a, b: a | b, [F.contains(text, normalize(F.lit(t))) for t in group]).cast("int") for group in groups]
    return reduce(lambda a, b: a + b, hit) / F.lit(float(len(groups)))


def unique_strings(a: Column | str) -> Column:
    """Trimmed strings, each normalised form once, in order."""
    trimmed = F.filter(F.transform(_col(a), lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")), lambda x: x != "")
    return F.filter(trimmed, lambda x, i: F.array_position(F.transform(trimmed, normalize), normalize(x)) == i + 1)


def parse_count(c: Column | str) -> Column:
    """Counts such as 1,234 or 1.2 with the ten-thousand sign, rounded half up; null if there is none."""
    bare = F.replace(clean(c), F.lit(","), F.lit(""))
    number = F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)?)\s*(万?)$", 1).try_cast("double")
    return F.floor(F.when(F.endswith(bare, F.lit("万")), number * 10000).otherwise(number) + 0.5)


def parse_year(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), "(1[89][0-9]{2}|2[01][0-9]{2})", 1), F.lit("")).try_cast("int")


# Roles that stand in brackets behind a name.
ROLE = r"\s*[（(](?:文|著|编|译|主编|编著|编译|撰|撰文|执笔|整理|口述|摄|图|供稿)[）)]$"


def author_names(a: Column | str) -> Column:
    """Names without the role behind them, each once."""
    return unique_strings(F.transform(_col(a), lambda x: F.regexp_replace(x, ROLE, "")))


def nonspace_chars(c: Column | str) -> Column:
    return F.char_length(F.regexp_replace(_col(c), BLANK, ""))


def has_han(c: Column | str) -> Column:
    return _col(c).rlike(r"\p{IsHan}")


def public_url(c: Column | str, hosts: tuple[str, ...] = ("example.org", "example.com")) -> Column:
    """The URL if it is https, on an allowed host, an abstract page and free of credential-like parameters; else empty."""
    c = _col(c)
    host = "|".join(h.replace(".", "[.]") for h in hosts)
    ok = c.rlike(rf"^https://([a-z0-9-]+[.])*({host})(:[0-9]+)?(/|\?|$)") & F.lower(c).rlike(r"^https://[^/?#]*/[^?#]*abstract")
    bad = F.lower(c).rlike(r"[?&][^=&#]*(token|ticket|session|password|signature)[^=&#]*(=|&|#|$)")
    return F.when(F.coalesce(ok & ~bad, F.lit(False)), c).otherwise("")


def markdown_text(c: Column | str) -> Column:
    return F.replace(F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def bib_text(c: Column | str) -> Column:
    """LaTeX escapes in one pass over the characters."""
    out = F.regexp_replace(_col(c), r"([{}%&#_$])", r"\\$1")
    # the backslash itself, told from those just added by what follows it
    return F.regexp_replace(out, r"\\(?![{}%&#_$])", r"\\textbackslash{}")


# Characters that file names may not hold, names that systems keep for themselves, what stands before a title that cannot be a name.
UNSAFE = r'[\x00-\x1F/\\<>:"|?*]'
RESERVED = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\.|$)"
NAME_PREFIX = "论文_"


def safe_file_name(c: Column | str) -> Column:
    """A title as a file name: odd characters become _, no dots or blanks at the ends, then at most 75 characters."""
    name = F.substr(F.btrim(F.regexp_replace(_col(c), UNSAFE, "_"), F.lit(". ")), F.lit(1), F.lit(75))
    return F.when((name == "") | name.rlike(RESERVED), F.concat(F.lit(NAME_PREFIX), name)).otherwise(name)
