"""Personal data in texts: patterns propose spans, checksums confirm them, nearby
words adjust the score. Native: built-in functions only, no shuffle, one row in and
one row out, so repeated rows, null ids and extra columns need no care.

Positions come from the gaps between the matches of a pattern: the text split by the
pattern gives the gaps, their lengths and those of the matches add up to the starts.
The sums run over blocks of about sqrt(n) matches, so a text with very many spans stays
cheap. Context words are looked for at the ends of the two gaps around a match.

The patterns take their matches in linear time whatever the text: parts that can match
in one way only are possessive, and a run of word characters is entered at its start
(or where the match before it ended), not at every character.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlake.llm.common import let, lower_ascii

BEFORE, AFTER = 60, 40          # characters of context
STEP = 0.3                      # a context word adds it, a word against takes it
ENOUGH = 0.5                    # score from which an added span counts

# Length of an IBAN by country code
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22,
    "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_pattern() -> str:
    """Every country's code and check digits, then as many further characters as its
    length leaves, singly preceded by a space or hyphen."""
    by_length: dict[int, list[str]] = {}
    for code, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(code)
    each = [f"(?:{'|'.join(codes)})[0-9][0-9](?:[ -]?[A-Z0-9]){{{n - 4}}}" for n, codes in sorted(by_length.items())]
    return f"(?:{'|'.join(each)})"


def only(m: Column, keep: str) -> Column:
    return F.regexp_replace(m, f"[^{keep}]", "")


def digits_between(m: Column, least: int, most: int) -> Column:
    return F.length(only(m, "0-9")).between(least, most)


def luhn(m: Column) -> Column:
    """The digits' sum, every second from the right doubled (less 9 above 9), ends in 0."""
    def body(d: Column) -> Column:
        n = F.length(d)

        def add(total: Column, i: Column) -> Column:
            x = F.substring(d, n - i + 1, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
            return total + x - F.when(x > 9, 9).otherwise(0)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0

    return let(only(m, "0-9"), body)


def mod97(m: Column) -> Column:
    """The first four characters moved to the end and letters read as 10 to 35, the number
    leaves 1 when divided by 97."""
    def body(d: Column) -> Column:
        turned = F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))

        def add(rest: Column, c: Column) -> Column:
            digit = c.between("0", "9")
            return F.when(digit, rest * 10 + c.cast("int")).otherwise(rest * 100 + F.ascii(c) - 55) % 97

        return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1

    return let(only(m, "A-Z0-9"), body)


def routing(m: Column) -> Column:
    """Nine digits weighted 3, 7, 1 add up to a multiple of 10; the first two name a district."""
    def body(d: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            weight = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(7)), (i % 3 + 1).cast("int"))
            return total + F.substring(d, i, F.lit(1)).cast("int") * weight

        ok = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0
        return ok & d.rlike("^(0[1-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)")

    return let(only(m, "0-9"), body)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str                              # for Java's matcher
    plain: str                                # the same without possessive parts and look-around; where
                                              # ``alone``, with the text's start or one character before it
    check: Callable[[Column], Column]         # drops failing matches, no retries
    score: float                              # of a confirmed match without context
    words: str = ""                           # context words for, alternatives of a pattern
    against: str = ""
    gate: str = ""                            # a text without this pattern holds no match
    alone: bool = False                       # a match goes on behind it if a letter or digit follows: dropped


_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

BASE = [
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: F.lit(True), 0.8,
         "mail|e-mail|email|contact|write|kontakt|correo", "example", gate="@"),
    Kind("ip", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: m.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"), 0.6,
         "ip|address|host|server|adresse|login", "version|release|section|chapter"),
    # runs of 2 to 12 digits or of 20 and more are matches of the plain pattern that fail
    Kind("card", r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
         r"[0-9]([\x20-]?[0-9])+", lambda m: digits_between(m, 13, 19) & luhn(m), 0.6,
         "card|credit|visa|mastercard|amex|debit|karte|carte|tarjeta|cvv|expires", "isbn|order|serial|tracking|invoice"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda m: digits_between(m, 9, 15), 0.6, "tel|phone|call|mobile|fax|telefon|whatsapp|cell", "=",
         gate=r"\+"),
]

_SSN, _NINE = "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{9}"
ADDED = [
    Kind("iban", rf"(?=[A-Z][A-Z][0-9][0-9])(?<![A-Za-z0-9]){iban_pattern()}",
         f"(?:^|[^A-Za-z0-9]){iban_pattern()}", mod97, 0.7,
         "iban|account|konto|bank|compte|cuenta|swift|bic", "test", gate="[A-Z][A-Z][0-9][0-9]", alone=True),
    Kind("ssn", "[0-9](?<![0-9A-Za-z-][0-9])[0-9][0-9]-[0-9]{2}-[0-9]{4}", f"(?:^|[^0-9A-Za-z-]){_SSN}",
         lambda m: ~only(m, "0-9").rlike("^(000|666|9)|^...00|0000$"), 0.3,
         "ssn|social|security|taxpayer", "part|order|serial|isbn", gate="-[0-9][0-9]-", alone=True),
    Kind("routing", "[0-9](?<![0-9A-Za-z.,-][0-9])[0-9]{8}", f"(?:^|[^0-9A-Za-z.,-]){_NINE}", routing, 0.3,
         "routing|aba|rtn", "order|serial|invoice", gate="[0-9]{9}", alone=True),
]


def running(lengths: Column) -> Column:
    """Sum of all earlier elements, for every element: within blocks of about sqrt(n)
    elements, and over the totals of the blocks before."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: t + x)

    def body(a: Column) -> Column:
        n = F.size(a)
        step = F.ceil(F.sqrt(n)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1),
                             lambda b: F.slice(a, b * step + 1, step))

        def spread(blocks: Column) -> Column:
            def within(sums: Column) -> Column:
                return F.flatten(F.transform(blocks, lambda x, b: let(
                    total(F.slice(sums, F.lit(1), b)),
                    lambda before: F.transform(x, lambda _, i: before + total(F.slice(x, F.lit(1), i))))))

            return let(F.transform(blocks, total), within)

        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(let(blocks, spread))

    return let(lengths, body)


def has_word(text: Column, words: str) -> Column:
    return lower_ascii(text).rlike(f"(^|[^a-z])({words})([^a-z]|$)") if words else F.lit(False)


def matched(text: Column, kind: Kind, enough: float) -> Column:
    """struct<gaps, found>: the pieces of the text between the matches of a kind, and for
    every match struct<kind, start, end, match, score, ok>. Positions count code points,
    ``end`` is exclusive."""
    def body(got: Column) -> Column:
        gaps, found = got["gaps"], got["found"]

        def located(starts: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                before, after = F.get(gaps, i), F.get(gaps, i + 1)
                start = F.get(starts, i) + F.char_length(before)
                whole = ~F.substring(after, 1, 1).rlike("[A-Za-z0-9]") if kind.alone else F.lit(True)
                near = F.concat(F.right(before, F.lit(BEFORE)), F.lit(" "), F.left(after, F.lit(AFTER)))
                score = F.round(F.least(F.lit(1.0), kind.score + STEP * has_word(near, kind.words).cast("int")
                                        - STEP * has_word(near, kind.against).cast("int")), 2)
                needed = F.lit(True) if kind in BASE else score >= enough
                return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"),
                                (start + F.char_length(m)).alias("end"), m.alias("match"),
                                score.alias("score"), (whole & kind.check(m) & needed).alias("ok"))

            return F.struct(gaps.alias("gaps"), F.transform(found, span).alias("found"))

        lengths = F.transform(found, lambda m, i: (F.char_length(F.get(gaps, i)) + F.char_length(m)).cast("bigint"))
        return let(running(lengths), located)

    gaps, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.gate:
        open_ = text.rlike(kind.gate)
        gaps, found = F.when(open_, gaps).otherwise(F.array(text)), F.when(open_, found).otherwise(
            F.array().cast("array<string>"))
    return let(F.struct(gaps.alias("gaps"), found.alias("found")), body)


SPAN = ("kind", "start", "end", "match", "score")


def find(docs: DataFrame, text_col: str = "text", kinds: list[Kind] | None = None, enough: float = ENOUGH,
         out: str = "pii") -> DataFrame:
    """``docs`` with a column ``out``: array<struct<kind, start, end, match, score>>, by kind in
    the order of ``kinds`` (base, then added), then start.

    Base spans stay whatever their score; added ones need ``enough``. Null or empty text has
    none; an empty table gives no rows; repeated rows are handled one by one; a column already
    named ``out`` is replaced, all others stay. Spans of different kinds may overlap.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    each = [F.transform(F.filter(matched(text, k, enough)["found"], lambda s: s["ok"]),
                        lambda s: F.struct(*[s[c].alias(c) for c in SPAN])) for k in kinds or [*BASE, *ADDED]]
    return docs.withColumn(out, F.concat(*each))


def cut_out(got: Column, tag: str) -> Column:
    """The text of ``matched`` with ``tag`` in place of every span."""
    def back(s: Column) -> Column:
        return F.when(s["ok"], F.lit(tag)).otherwise(s["match"])

    return F.array_join(F.flatten(F.transform(got["gaps"], lambda g, i: F.array(
        g, F.coalesce(back(F.get(got["found"], i)), F.lit(""))))), "")


def cutter(tag: str) -> Callable[[Column], Column]:
    return lambda got: cut_out(got, tag)


def redact(docs: DataFrame, text_col: str = "text", kinds: list[Kind] | None = None,
           enough: float = ENOUGH) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, kind after kind in the order
    iban, card and the rest, so that no kind cuts into the digits of another. Null text
    stays null; all other columns stay."""
    first = {"iban": 0, "card": 1}
    text = F.col(f"`{text_col}`")
    for k in sorted(kinds or [*BASE, *ADDED], key=lambda k: first.get(k.name, 2)):
        tag = f"[{k.name.upper()}]"
        docs = docs.withColumn(text_col, F.when(text.isNotNull(), let(
            matched(text, k, enough), cutter(tag))))
    return docs


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
