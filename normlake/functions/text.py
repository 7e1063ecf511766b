"""Column functions: cleaning a page, keys, labels, exports. All but nfkc() stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Blanks as the rules mean them, no-break and other wide ones included: Java's \\s is ASCII only.
WS = "[ \\t\\n\\x0B\\f\\r\\u00A0\\uFEFF\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
#: Between the body of a page and its small print.
FOOTNOTE_MARK = "\n⁣FN⁣\n"
# Glyph codes beyond the shifted range; patterns of header lines, of hyphens at a line's end, of prose in registers.
SHIFT_SPECIALS = {0x62: "ä", 0x67: "Ö", 0x68: "Ü", 0x6C: "ä", 0x7C: "ö", 0x81: "ü", 0x89: "ß", 0x86: "§", 0xAB: "–", 0xB1: "–", 0x2212: "-", 0xC4: "„", 0xB3: "“"}
HEADER_LENGTH, SENTENCE_END, LETTER, NUMBER_FIRST, NUMBER_LAST = 80, "[.!?]$", "[A-Za-zÄÖÜäöüß]", f"^[0-9]{{1,4}}{WS}+\\S", f"{WS}[0-9]{{1,4}}$"
WIDE_BLANK, BROKEN_WORD, BROKEN_NAME = "[\\u00A0\\u2000-\\u200B\\u202F\\u205F\\u2060\\u3000]", "([a-zäöüß])-[ \\t]*\\n[ \\t]*([a-zäöüß])", "-[ \\t]*\\n[ \\t]*(?=[A-ZÄÖÜ])"
PROSE = "(?:\\p{Ll}{3,}\\s+){5}\\p{Ll}{3,}"
# A token of a register of laws.
REGISTER_TOKEN = (
    "^(?:§§?|Artt?\\.?|[0-9]{1,4}[a-z]{0,2}[.,;:]?|[IVXLivxl]{1,6}[.,;:]?|[a-zß]{1,2}[.,;:]?|ff?\\s?\\.[,;]?|Fn\\.?|pr\\.?[,;]?|Rn\\.?|Nrn?\\.?|Abs\\.?|S\\.?"
    "|Hs\\.?|a\\.E\\.[,;]?|[,;.:()–—-]+|\\.{2,}|[A-ZÄÖÜ][A-Za-z0-9ÄÖÜäöüß./§-]{0,29}:?)$"
)


#: The same blanks as characters, and all of them but the plain one.
_BLANKS = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_OTHER = WS.replace("[ ", "[", 1)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def single_blanks(c: Column) -> Column:
    """Every run of blanks as one plain blank; text that has only those is left as it is."""
    return F.regexp_replace(c, f"{WS}{{2,}}|{_OTHER}", " ")


def _nfkc(s: pa.Array) -> pa.Array:
    """Only strings beyond ASCII become Python objects. (Arrow's own utf8_normalize leaves NFKC decomposed.)"""
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(s)), False)
    if not pc.any(odd).as_py():
        return s
    return pc.replace_with_mask(s, odd, pa.array([unicodedata.normalize("NFKC", x) for x in s.filter(odd).to_pylist()], s.type))


@F.arrow_udf(StringType())
def nfkc(s: pa.Array) -> pa.Array:
    return _nfkc(s)


def nfkc_arrays(df: DataFrame, column: str, *names: str) -> DataFrame:
    """df with nfkc() of the named fields of an array<struct> column: whole batches in one call."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = b.column(at)
            each = arrays.values
            fields = [_nfkc(each.field(f.name)) if f.name in names else each.field(f.name) for f in each.type]
            yield b.set_column(at, column, pa.ListArray.from_arrays(arrays.offsets, pa.StructArray.from_arrays(fields, fields=list(each.type))))

    return df.mapInArrow(run, df.schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row: named columns are put in place of their names by the optimizer, lambda variables are not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unshifted(raw: Column) -> Column:
    """Text whose glyph codes stand 0x1D too low, put right; only where a tenth are control characters and the outcome reads like text."""
    shifted = [c for c in range(3, 0x62) if c not in (9, 10, 13)]
    source = "".join(map(chr, shifted)) + "".join(map(chr, SHIFT_SPECIALS))
    target = "".join(chr(c + 0x1D) for c in shifted) + "".join(SHIFT_SPECIALS.values())
    total = F.length(F.regexp_replace(raw, "[\\n\\r\\t]", ""))
    control = F.length(F.regexp_replace(raw, "[^\\x03-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))
    out = F.translate(raw, source, target)
    readable = F.length(F.regexp_replace(out, "[^A-Za-zÄÖÜäöüß0-9 .,§()]", ""))
    # Hardly any page has a control character: the others are looked through once.
    return F.when(raw.rlike("[\\x03-\\x08\\x0B\\x0C\\x0E-\\x1F]"), F.when((total >= 50) & (control / total >= 0.1) & (readable / total > 0.85), out).otherwise(raw)).otherwise(raw)


def single_layer(raw: Column) -> Column:
    """Text without its second copy: from where its first 80 characters come again, if that is behind its first third."""
    probe = F.substring(F.ltrim(raw, F.lit(_BLANKS)), 1, 80)
    again = F.call_function("locate", probe, raw, F.lit(101)) - 1
    return F.when((F.length(probe) >= 40) & (again > F.length(raw) / 3), F.substring(raw, F.lit(1), again)).otherwise(raw)


def body(raw: Column) -> Column:
    at = F.instr(raw, FOOTNOTE_MARK)
    return F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(raw)


def small_print(raw: Column) -> Column:
    at = F.instr(raw, FOOTNOTE_MARK)
    return F.when(at > 0, F.substring(raw, at + len(FOOTNOTE_MARK), F.length(raw))).otherwise(F.lit(""))


def without_bare_numbers(raw: Column) -> Column:
    return F.array_join(F.filter(F.split(raw, "\n", -1), lambda x: ~trimmed(x).rlike("^[0-9]{1,4}$")), "\n")


def header_like(line: Column) -> Column:
    numbered = line.rlike(NUMBER_FIRST) | line.rlike(NUMBER_LAST)
    return F.length(line).between(1, HEADER_LENGTH) & ~F.contains(line, F.lit("§")) & ~line.rlike(SENTENCE_END) & line.rlike(LETTER) & numbered


def without_running_header(raw: Column) -> Column:
    lines = F.split(raw, "\n", -1)
    first, second = trimmed(lines[0]), trimmed(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    drop = (F.instr(raw, "\n") > 1) & header_like(first) & ~header_like(second)
    return F.when(drop, F.substring(raw, F.instr(raw, "\n") + 1, F.length(raw))).otherwise(raw)


def line_form(line: Column) -> Column:
    """A line with its numbers as one sign each and single blanks: equal for repeated headers."""
    return trimmed(single_blanks(F.regexp_replace(line, "[0-9]+", "#")))


def tidied(s: Column) -> Column:
    """Text in NFKC without soft hyphens, wide blanks, words broken at a line's end and runs of blanks."""
    s = F.regexp_replace(F.replace(s, F.lit("\u00ad"), F.lit("")), WIDE_BLANK, " ")
    s = F.regexp_replace(F.regexp_replace(s, BROKEN_WORD, "$1$2"), BROKEN_NAME, "-")
    return trimmed(single_blanks(s))


def cleaned(raw: Column) -> Column:
    return tidied(nfkc(raw))


def register_like(text: Column) -> Column:
    """Twelve lines or more, eight signs or more; at least 60 % of the lines are mostly tokens of a register and at most 15 % prose."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: F.length(x) > 0)
    prose = lambda x: x.rlike(PROSE)
    tokens = lambda x: F.split(x, f"{WS}+", -1)
    good = lambda x: F.size(F.filter(tokens(x), lambda t: t.rlike(REGISTER_TOKEN))) / F.size(tokens(x)) >= 0.7
    n = F.size(lines)
    dense = (n >= 12) & (F.length(text) - F.length(F.replace(text, F.lit("§"), F.lit(""))) >= 8)
    return F.coalesce(dense & (F.size(F.filter(lines, lambda x: ~prose(x) & good(x))) / n >= 0.6) & (F.size(F.filter(lines, prose)) / n <= 0.15), F.lit(False))


def code_key(code: Column) -> Column:
    """Codes compare in lower case without blanks, dots, hyphens and en dashes."""
    return F.regexp_replace(F.lower(code), f"{WS[:-1]}.\\-–]", "")


def number_prefix(number: Column) -> Column:
    return F.regexp_extract(number, "^([0-9]+)", 1).try_cast("int")


def canonical(ref: Column, modifiers: Column, code: Column) -> Column:
    """ref: struct of kind, number, number_end, ff, details."""
    ranged = ref["number_end"].isNotNull()
    sign = F.when(ranged & (ref["kind"] == "§"), "§§").when(ranged, "Artt.").otherwise(ref["kind"])
    number = F.concat(sign, F.lit(" "), ref["number"], F.coalesce(F.concat(F.lit("–"), ref["number_end"]), F.lit("")), F.coalesce(F.concat(F.lit(" "), ref["ff"]), F.lit("")))
    details = F.transform(ref["details"], lambda d: F.concat(d["level"], F.lit(" "), d["value"]))
    return F.concat_ws(" ", number, details, F.filter(modifiers, lambda m: m != "Rn-context"), code)


def norm_label(kind: Column, number: Column, number_end: Column, ff: Column) -> Column:
    ranged = F.concat(F.when(kind == "§", "§§").otherwise("Artt."), F.lit(" "), number, F.lit("–"), number_end)
    return F.concat(F.coalesce(ranged, F.concat(kind, F.lit(" "), number)), F.when(ff == "ff.", F.lit(" ff.")).otherwise(F.lit("")))


def span_width(number: Column, number_end: Column) -> Column:
    return F.when(number_end.isNotNull(), number_prefix(number_end) - number_prefix(number) + 1).otherwise(F.lit(1))


def csv_field(v: Column) -> Column:
    return F.when(v.rlike('[";\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def html_escaped(v: Column) -> Column:
    return F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def german_date(iso: Column) -> Column:
    return F.date_format(iso.cast("date"), "d.M.yyyy")


def stripped_xml(text: Column) -> Column:
    """Text without tags, four entities read (the ampersand first), blanks single."""
    s = F.regexp_replace(text, "<[^>]+>", " ")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        s = F.replace(s, F.lit(a), F.lit(b))
    return trimmed(single_blanks(s))
