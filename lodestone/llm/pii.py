"""Personal data: regular expressions propose spans, checksums confirm them, context words score them.

Base kinds are email, ip, card (Luhn) and phone. Further kinds are iban (mod 97), national_id and
secret, which count only if the checksum holds or a context word stands near: on either side, in the
text between the spans that the kind's pattern proposes. The patterns are the documented ones with
possessive quantifiers and anchored starts, which changes no match but keeps the search linear in
long runs; places are running totals, so the whole work is n log n in the number of spans.
DataFrame functions only.

Defined cases: a null text counts as empty and has no span; repeated rows give equal results; an
empty table gives an empty result; detect() and redact() pass all other columns through, and a
column with the name of detect()'s result goes on as `<name>_input`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bind, find_all, make_room, running, text_of

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "secret")
BASE_KINDS = KINDS[:4]
CONTEXT_CHARS = 40
LEAST_SCORE = 0.5

# A match can only begin where no character of its first run stands before, or behind the last match.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])",
}
# A text without this cannot hold a span that counts.
GATES = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Fa-f0-9]{32}",
}
CONTEXT = {
    "email": r"mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|credit|visa|payment|account",
    "phone": r"phone|tel|call|mobile|fax",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "national_id": r"ssn|social security|national id|tax id",
    "secret": r"token|secret|passw|api|key|auth",
}
# Score without and with a context word.
SCORES = {"email": (0.9, 1.0), "ip": (0.7, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.9), "iban": (0.9, 1.0), "national_id": (0.3, 0.8), "secret": (0.2, 0.7)}


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a correct Luhn check digit."""

    def add(total: Column, i: Column) -> Column:
        x = F.ascii(F.substr(digits, F.char_length(digits) - i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number (capitals and digits) leaves 1 on division by 97, its first four at the end."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        x = F.ascii(c)
        return F.when(x >= 65, rest * 100 + x - 55).otherwise(rest * 10 + x - 48) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        n = F.char_length(_digits(m))
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(m)).between(10, 15)
    if kind == "iban":
        bare = F.replace(m, F.lit(" "), F.lit(""))
        return F.char_length(bare).between(15, 34) & mod97(bare)
    return F.lit(True)


def _kind_spans(text: Column, rank: int, kind: str) -> Column:
    plain, near = SCORES[kind]

    def span(x: Column) -> Column:
        beside = ascii_lower(F.concat(x["before"], F.lit(" "), x["after"]))
        score = F.when(beside.rlike(CONTEXT[kind]), near).otherwise(plain)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.char_length(x["match"])).alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    spans = F.transform(F.filter(find_all(text, PATTERNS[kind], CONTEXT_CHARS), lambda x: _valid(kind, x["match"])), span)
    return spans if kind in BASE_KINDS else F.filter(spans, lambda x: x["score"] >= LEAST_SCORE)


def find_spans(text: Column) -> Column:
    """Spans of a text: array of (start, rank, end, kind, score) by start and kind; code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    parts = [F.when(text.rlike(GATES[kind]), _kind_spans(text, rank, kind)) for rank, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*[F.coalesce(p, none) for p in parts]))


def detect(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """docs with a column of spans."""
    docs = make_room(docs, into)
    # the coalesced text is a column of its own, so that lambdas do not evaluate it again
    return docs.withColumn("__text", text_of(docs, text)).withColumn(into, find_spans(F.col("__text"))).drop("__text")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; of overlapping spans the first names the place.

    The text is cut as UTF-32, where the place of a character is known, and joined as hexadecimal
    digits, so each character is copied a fixed number of times. A first character that is dropped
    again keeps a byte order mark of the text from being read as one.
    """
    lead = "0000002E"

    def code(c: Column) -> Column:
        return F.hex(F.encode(c, "UTF-32"))

    def of(raw: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            return F.hex(F.substr(raw, 4 * a + 1, 4 * (b - a)))

        def part(x: Column, i: Column, reach: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0))
            return F.when(x["start"] >= at, F.concat(cut(at, x["start"]), code(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))).otherwise("")

        def parts(reach: Column) -> Column:
            tail = F.hex(F.substr(raw, 4 * F.array_max(reach) + 1))
            return F.concat(F.lit(lead), F.array_join(F.transform("__spans", lambda x, i: part(x, i, reach)), ""), tail)

        return bind(running(F.transform("__spans", lambda x: x["end"]), F.greatest), parts)

    new = F.substr(F.decode(F.unhex(bind(F.encode("__text", "UTF-32"), of)), "UTF-32"), F.lit(2))
    found = docs.withColumn("__text", text_of(docs, text)).withColumn("__spans", find_spans(F.col("__text")))
    return found.withColumn(text, F.when(F.size("__spans") > 0, new).otherwise(F.col(text))).drop("__text", "__spans")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["rank"] < len(BASE_KINDS))
    score = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    return out.select("doc_id", *[number(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), score.alias("max_score"))
