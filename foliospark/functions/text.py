"""Column functions on strings. White space is Unicode white space unless a name says otherwise."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end, no-break spaces included (plain trim only knows blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def pad_number(c: Column, width: int) -> Column:
    """Zero-padded, never cut (lpad cuts longer numbers)."""
    s = c.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(s), F.lit(0))), s)


def half_up(c: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(c + 0.5)


def band_text(c: Column) -> Column:
    """Identity of a header or footer: trimmed, lower case, each digit as #, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[0-9]", "#"), r"(?U)\s+", " ")


def export_band_text(c: Column) -> Column:
    """The same for export: a run of digits is one #, and white space goes altogether."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "#"), r"(?U)\s+", "")


def looks_like_bates(c: Column) -> Column:
    """A letter, up to 19 more letters or digits, maybe a separator, then 3 to 10 digits."""
    # Fixed value: the format of such a label.
    return strip(c).rlike(r"^[A-Za-z][A-Za-z0-9]{0,19}[ _.-]?[0-9]{3,10}$")


def printed_page(c: Column) -> Column:
    """The number in `Page 4 of 37`, `Page4`, `- 4 -` (any dashes), `[[4]]`, `(4) of10` or `4`; null otherwise and for 0."""
    # Fixed value: the format of a printed page number.
    n = F.regexp_extract(strip(c), r"(?i)^(?:page\s*)?[\[(\-–—\s]*([0-9]{1,4})[\])\-–—\s]*(?:of\s*[0-9]{1,4})?$", 1)
    value = F.when(n != "", n.cast("int"))
    return F.when(value > 0, value)


def line_number(c: Column, most: int = 28) -> Column:
    """A bare number from 1 to most; null otherwise."""
    n = F.when(strip(c).rlike("^[0-9]{1,2}$"), strip(c).cast("int"))
    return F.when(n.between(1, most), n)


def opens_block(c: Column) -> Column:
    """Question and answer marks, speakers, numbered or bulleted items."""
    # The openers of a block.
    return c.rlike(
        r"^(Q[.:]|A[.:]|THE (COURT|WITNESS|REPORTER|CLERK)\b|(MR|MS|MRS|DR)\.\s|BY (MR|MS|MRS|DR)\.|\(\w{1,3}\)\s|\d{1,3}[.)]\s|[•▪‣◦●]\s|[-–—]\s)"
    )


def leader_parts(c: Column) -> Column:
    """Text before a dot leader of five dots or more, and what follows it (null without a leader)."""
    pattern = r"^(.*?)[.\s·…]*\.{5,}[.\s·…]*([^.\s·…].*)?$"
    return F.when(
        c.rlike(r"\.{5,}"),
        F.struct(F.regexp_extract(c, pattern, 1).alias("before"), F.regexp_extract(c, pattern, 2).alias("after")),
    )


def joins_hyphen(previous: Column, following: Column) -> Column:
    """Whether a line-end hyphen only breaks a word: a letter and hyphen, then a lower-case letter."""
    return previous.rlike("[A-Za-z]-$") & following.rlike("^[a-z]")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, in base 36."""
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("([0-9A-F]{4})"), 1)
    offset, prime, mask = F.lit(2166136261).cast("long"), F.lit(16777619), F.lit(4294967295)
    h = F.aggregate(units, offset, lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * prime).bitwiseAND(mask))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def needle_forms(c: Column) -> Column:
    """How a term may lie in a byte stream: lower case, Latin-1 hex, UTF-16BE hex."""
    return F.struct(
        F.lower(c).alias("literal"),
        F.lower(F.hex(F.encode(c, "ISO-8859-1"))).alias("latin1_hex"),
        F.lower(F.hex(F.encode(c, "UTF-16BE"))).alias("utf16_hex"),
    )


def strip_tags(c: Column) -> Column:
    """Without tags, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))


def escape_html(c: Column) -> Column:
    """& first, then the other signs."""
    # Signs and their entities.
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def decode_entities(c: Column) -> Column:
    """Entities decoded in one pass: what an entity yields is not decoded again. Unknown ones stay.

    The ampersand's own entity is set aside under a private character first and comes back last.
    """
    aside = "\ue000"
    c = F.replace(c, F.lit("&amp;"), F.lit(aside))
    # Named entities.
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return F.replace(c, F.lit(aside), F.lit("&"))


def header_safe(c: Column) -> Column:
    """One line, so that nothing can start a header of its own."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def roman_value(c: Column) -> Column:
    """Value of a lower-case Roman numeral up to 89: each sign counts negative before a larger one."""
    worth = F.create_map(*[F.lit(x) for pair in (("i", 1), ("v", 5), ("x", 10), ("l", 50)) for x in pair])
    signs = F.transform(F.split(c, ""), lambda s: F.element_at(worth, s))
    signed = F.transform(signs, lambda v, i: F.when(F.get(signs, i + 1) > v, -v).otherwise(v))
    return F.when(c.rlike("^[ivxl]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def roman_numeral(c: Column) -> Column:
    """Lower-case Roman numeral of 1 to 89."""
    tens = F.array(*[F.lit(x) for x in ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx")])
    ones = F.array(*[F.lit(x) for x in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")])
    return F.when(
        c.between(1, 89), F.concat(F.element_at(tens, F.floor(c / 10).cast("int") + 1), F.element_at(ones, (c % 10).cast("int") + 1))
    )


def letters_of(c: Column) -> Column:
    """1 = A, 26 = Z, 27 = AA, up to three letters."""
    z = c - 1
    one = F.char(F.pmod(z, F.lit(26)) + 65)
    two = F.char(F.pmod(F.floor((z - 26) / 26), F.lit(26)) + 65)
    three = F.char(F.pmod(F.floor((z - 702) / 676), F.lit(26)) + 65)
    return F.when(z < 26, one).when(z < 702, F.concat(two, one)).when(z < 18278, F.concat(three, two, one))


def value_of_letters(c: Column) -> Column:
    """The inverse of letters_of."""
    return F.aggregate(F.split(F.upper(c), ""), F.lit(0), lambda a, s: a * 26 + F.ascii(s) - 64)


# The date stamp formats and Spark's patterns for them.
DATE_FORMATS = {
    "MM/DD/YYYY": "MM/dd/yyyy",
    "DD/MM/YYYY": "dd/MM/yyyy",
    "YYYY-MM-DD": "yyyy-MM-dd",
    "MMMM D, YYYY": "MMMM d, yyyy",
}


def date_stamp(c: Column, style: str) -> Column:
    """A date in one of DATE_FORMATS; the first for an unknown style."""
    return F.date_format(c, DATE_FORMATS.get(style, DATE_FORMATS["MM/DD/YYYY"]))


def natural_key(c: Column, width: int = 12) -> Column:
    """Sort key for natural order: lower case, numbers padded. Case and accents need a collation beyond that."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), pad_number(r, width)).otherwise(r)), "")


def citation(first_page: Column, first_line: Column, last_page: Column, last_line: Column) -> Column:
    """(12:3), (12:3-5) or (12:3-13:1), whichever way round the ends are given."""
    a = F.least(F.struct(first_page.alias("p"), first_line.alias("l")), F.struct(last_page.alias("p"), last_line.alias("l")))
    b = F.greatest(F.struct(first_page.alias("p"), first_line.alias("l")), F.struct(last_page.alias("p"), last_line.alias("l")))
    start = F.concat(a["p"].cast("string"), F.lit(":"), a["l"].cast("string"))
    end = F.when((a["p"] == b["p"]) & (a["l"] == b["l"]), F.lit("")).when(
        a["p"] == b["p"], F.concat(F.lit("-"), b["l"].cast("string"))
    ).otherwise(F.concat(F.lit("-"), b["p"].cast("string"), F.lit(":"), b["l"].cast("string")))
    return F.concat(F.lit("("), start, end, F.lit(")"))


def plural(count: Column, one: str, many: str) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, one).otherwise(many))


def file_stem(c: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def file_extension(c: Column) -> Column:
    """Lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(F.regexp_extract(c, r"([^/\\]*)$", 1), r".(\.[^.]*)$", 1))


def hex_colour(c: Column) -> Column:
    """struct(r, g, b) of #rgb or #rrggbb, with or without #; null otherwise."""
    s = F.lower(F.regexp_replace(c, "^#", ""))
    six = F.when(s.rlike("^[0-9a-f]{3}$"), F.regexp_replace(s, "(.)", "$1$1")).when(s.rlike("^[0-9a-f]{6}$"), s)
    part = lambda at: F.conv(F.substring(six, at, 2), 16, 10).cast("int")
    return F.when(six.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def mask_terms(c: Column, pattern: str, sign: str = "█") -> Column:
    """Every match as many signs long as it was; pattern is a Java regular expression."""
    return F.regexp_replace(c, pattern, sign)


def word_starts(line: Column) -> Column:
    """The places, in characters from 0, at which the words between single blanks start: as many as F.split(line, " ") has.

    On whole batches of lines by numpy; a window over words, or a sum over an array, costs several times as much.
    """

    def starts(lines: pa.Array) -> pa.Array:
        ends = np.frombuffer(lines.buffers()[1], dtype=np.int32 if pa.types.is_string(lines.type) else np.int64)[lines.offset : lines.offset + len(lines) + 1]
        data = lines.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends.astype(np.int64) - ends[0]
        before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
        blanks = np.flatnonzero(data == 32)
        row = np.searchsorted(ends, blanks, side="right") - 1
        places = np.zeros(len(blanks) + len(lines), dtype=np.int32)
        places[np.arange(1, len(blanks) + 1) + row] = before[blanks] + 1 - before[ends[row]]
        first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lines)) + 1)])
        return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(places))

    return F.arrow_udf(starts, "array<int>")(F.coalesce(line, F.lit("")))
