"""Cleaned pages to citations: one text for each document, reading, pages of offsets, checks of codes and contexts.

Defined results: doc_id has any type, and its null is a document; null texts and documents without a sign give no citation; a text of any
length is read whole; repeated pages are read each; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.functions import grammar
from normlake.functions import text as T
from normlake.operators import registry
from normlake.session import ensure_code

#: Greatest section number that is taken for one; characters of context that the checks look at.
MAX_SECTION, BEFORE, AFTER = 2500, 60, 80
# Contexts of literature; codes that are none; words of prose, and endings of names of laws.
RN_AFTER = "^\\s*(?:Rn|Rdnr|Rz|Rnr)\\.?\\s*[0-9]"
HEADING_AFTER = "^\\s[A-ZÄÖÜ][a-zäöüß]{2,}"
PAGE_AFTER = "^\\s?,\\s?S\\.\\s?[0-9]"
EDITION_BEFORE = "[0-9]{1,2}\\.\\s?Aufl\\.?\\s?[0-9]{0,4},?\\s*$"
AUTHOR_BEFORE = (
    "(?:[A-ZÄÖÜ][a-zäöüß]+(?:/[A-ZÄÖÜ][a-zäöüß]+)+,?\\s+(?:[A-Z0-9][A-Za-z0-9.\\-]*\\s?){0,4},?\\s*"
    "|[A-ZÄÖÜ][a-zäöüß]+,\\s*[A-Za-zÄÖÜäöüß.\\- ]{1,28},\\s*)(?:vor\\s|Einf\\.\\s*v\\.\\s*)?$"
)
RN_CODE = "^(?i:Rn|Rdnr|Rz|Rnr)\\.?[0-9]*$"
OUTLINE = "^(?:[IVX]+(?:\\s[0-9]+)?|[A-ZÄÖÜ])$"
PROSE, LAW_NAME = "^[A-ZÄÖÜ][a-zäöüß]+$", "(?i)(?:gesetz|gesetzbuch|verordnung|ordnung)$"

_DETAILS = pa.list_(pa.struct([("level", pa.string()), ("value", pa.string())]))
_RAW = [
    ("chain_no", pa.int32()), ("leg_no", pa.int32()), ("ref_no", pa.int32()), ("raw", pa.string()), ("page", pa.int32()), ("char_index", pa.int32()),
    ("kind", pa.string()), ("number", pa.string()), ("number_end", pa.string()), ("ff", pa.string()), ("details", _DETAILS), ("candidate", pa.string()),
    ("modifiers", pa.list_(pa.string())), ("extra", pa.bool_()), ("connected", pa.bool_()), ("n_chain", pa.int32()), ("before", pa.string()), ("after", pa.string()),
]
#: Behind the column doc_id, of any type.
RAW_SCHEMA = (
    "chain_no int, leg_no int, ref_no int, raw string, page int, char_index int, kind string, number string, number_end string, ff string, "
    "details array<struct<level:string,value:string>>, candidate string, modifiers array<string>, extra boolean, connected boolean, n_chain int, before string, after string"
)
#: Documents whose pages are Python objects at once.
AT_ONCE = 64


def documents(clean: DataFrame) -> DataFrame:
    """doc_id, pages: all pages of a document in order, as one row. Takes pages or documents as cleaning makes them. A document is a book:
    bounded, and the unit in which citations run on."""
    if "pages" in clean.columns:
        return clean
    return clean.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "body", "small"))).alias("pages"))


def assembled(pages: list[tuple]) -> tuple[str, list[int], list[int]]:
    """Of (page, body, small): bodies first, then what small print there is, so that sentences go on over page breaks; starts and pages of the pieces."""
    parts, starts, of, at = [], [], [], 0
    for page, body, _ in pages:
        starts.append(at)
        of.append(page)
        parts.append(body + " ")
        at += len(parts[-1])
    parts.append(".\n")
    at += 2
    for page, _, small in pages:
        if small:
            starts.append(at)
            of.append(page)
            parts.append(small + " ")
            at += len(parts[-1])
    return "".join(parts), starts, of


def joined_text(clean: DataFrame) -> DataFrame:
    """doc_id, text: the text in which char_index counts."""
    small = F.filter("pages", lambda p: p["small"] != "")
    text = F.concat(F.array_join(F.transform("pages", lambda p: F.concat(p["body"], F.lit(" "))), ""), F.lit(".\n"), F.array_join(F.transform(small, lambda p: F.concat(p["small"], F.lit(" "))), ""))
    return documents(clean).select("doc_id", text.alias("text"))


def read(clean: DataFrame) -> DataFrame:
    """Citations as written: doc_id and RAW_SCHEMA. Documents without a sign are passed over before they reach Python."""
    ensure_code(clean.sparkSession)
    sign = F.exists("pages", lambda p: p["body"].rlike("§|Art") | p["small"].rlike("§|Art"))
    texts = documents(clean).where(sign).select("doc_id", "pages")
    names = ["doc_id", *(n for n, _ in _RAW)]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(at, AT_ONCE)
                bounds, each = b.column(1).offsets.to_pylist(), b.column(1).values
                each = each.slice(bounds[0], bounds[-1] - bounds[0])
                pages = list(zip(*(each.field(f).to_pylist() for f in ("page", "body", "small"))))
                of, rows = [], []
                for k, (a, z) in enumerate(zip(bounds, bounds[1:])):
                    found = _read_one(pages[a - bounds[0] : z - bounds[0]])
                    of += [k] * len(found)
                    rows += found
                columns = [_listed(v) if t is _DETAILS else pa.array(v, t) for v, (_, t) in zip(zip(*rows) if rows else [[]] * len(_RAW), _RAW)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *columns], names=names)

    return texts.mapInArrow(run, f"doc_id {clean.schema['doc_id'].dataType.simpleString()}, {RAW_SCHEMA}")


def _listed(details: list[list[tuple[str, str]]]) -> pa.Array:
    """Lists of (level, value) as _DETAILS, from flat columns: Arrow takes many times longer over dictionaries."""
    flat = [x for d in details for x in d]
    pairs = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.string()) for k in (0, 1)], names=["level", "value"])
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, details), initial=0), pa.int32()), pairs)


def _read_one(pages: list[tuple]) -> list[tuple]:
    """The values of _RAW for each citation of a document."""
    text, starts, of = assembled(pages)
    rows = []
    for chain, (a, z, found, connected) in enumerate(grammar.citations(text)):
        context = len(found), text[max(0, a - BEFORE) : a], text[z : z + AFTER]
        for k, c in enumerate(found):
            n, page = c.norm, of[bisect.bisect_right(starts, c.at) - 1]
            rows.append((chain, c.leg, k, c.raw, page, c.at, n.kind, n.number, n.number_end, n.ff, n.details, c.candidate, c.modifiers, c.extra, connected, *context))
    return rows


def check(raw: DataFrame, known: DataFrame, implicit_code: str | None = None, drop_rn: bool = False) -> DataFrame:
    """Citations: law codes checked, literature marked (verweis), junk dropped. `unresolved` holds a code that is kept without being known."""
    rn_code = F.coalesce(F.element_at(F.split("candidate", " "), 1).rlike(RN_CODE), F.lit(False))
    outline = F.col("candidate").rlike(OUTLINE)
    rn = rn_code | F.col("after").rlike(RN_AFTER)
    rows = raw.where(~((F.col("kind") == "§") & (T.number_prefix(F.col("number")) > MAX_SECTION)))
    rows = rows.withColumn("modifiers", F.when(rn, F.array_union("modifiers", F.array(F.lit("Rn-context")))).otherwise(F.col("modifiers")))
    rows = rows.withColumn("candidate", F.when(~rn_code & ~outline, F.col("candidate")))
    # Digits of a footnote stick to a code: a second try without them.
    glued = F.col("candidate").rlike("[0-9]$") & ~F.col("candidate").rlike("[\\s/]")
    bare_code = F.regexp_replace(F.regexp_replace("candidate", "[0-9]+$", ""), "[.,;:]+$", "")
    rows = rows.withColumn("short", F.when(glued & (F.length(bare_code) >= 2), bare_code))
    keep = ["verdict", "display", "slug", "is_eu", "work_kind", "repealed", "successor"]
    rows = registry.resolve(registry.resolve(rows, known, "candidate"), known, "short", "s_").drop(*(k for k in keep if k != "verdict"), *(f"s_{k}" for k in keep if k != "verdict"))
    use_short = F.coalesce((F.col("verdict") == "unknown") & (F.col("s_verdict") == "known"), F.lit(False))
    code, verdict = F.when(use_short, F.col("short")).otherwise(F.col("candidate")), F.when(use_short, F.lit("known")).otherwise(F.col("verdict"))
    prose = code.rlike(PROSE) & ~code.rlike(LAW_NAME)
    rows = rows.withColumn("law_code", F.when(verdict == "known", code).when((verdict == "unknown") & ~prose, code))
    rows = rows.withColumn("unresolved", F.when((verdict == "unknown") & F.col("law_code").isNotNull(), F.col("law_code")))
    rows = rows.where(~F.col("extra") | F.col("law_code").isNotNull())
    bare = (F.col("kind") == "§") & (F.size("details") == 0) & F.col("number_end").isNull() & F.col("ff").isNull()
    heading = (F.col("n_chain") == 1) & F.col("after").rlike(HEADING_AFTER)
    literature = F.array_contains("modifiers", "Rn-context") | F.col("before").rlike(AUTHOR_BEFORE) | F.col("after").rlike(PAGE_AFTER) | F.col("before").rlike(EDITION_BEFORE) | (heading & bare)
    rows = rows.withColumn("verweis", F.col("law_code").isNull() & literature)
    takes = ~F.col("verweis") & F.col("law_code").isNull() & F.lit(implicit_code is not None)
    rows = rows.withColumn("implicit", takes).withColumn("law_code", F.when(takes, F.lit(implicit_code)).otherwise(F.col("law_code")))
    if drop_rn:
        rows = rows.where(~F.array_contains("modifiers", "Rn-context"))
    ref = F.struct("kind", "number", "number_end", "ff", "details")
    law_key = F.when(F.col("verweis"), "[Verweis]").otherwise(F.coalesce(T.code_key(F.col("law_code")), F.lit("[?]")))
    return rows.select(
        "doc_id", "chain_no", "leg_no", "ref_no", "raw", "page", "char_index", "kind", "number", T.number_prefix(F.col("number")).alias("num_int"), "number_end", "ff", "details", "law_code",
        law_key.alias("law_key"), "implicit", "modifiers", F.when(F.col("connected"), F.concat_ws("-", "doc_id", "chain_no")).alias("chain_id"), "verweis",
        T.canonical(ref, F.col("modifiers"), F.col("law_code")).alias("canonical"), "unresolved",
    )


def extract(clean: DataFrame, known: DataFrame, implicit_code: str | None = None, drop_rn: bool = False) -> DataFrame:
    return check(read(clean), known, implicit_code, drop_rn)


def unresolved(citations: DataFrame) -> DataFrame:
    """doc_id, code, n, message: codes kept without being known."""
    n = citations.where(F.col("unresolved").isNotNull()).groupBy("doc_id", F.col("unresolved").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("message", F.concat(F.lit("Unbekanntes Kürzel „"), F.col("code"), F.lit("“ ("), F.col("n").cast("string"), F.lit("×) – wird ohne Prüfung übernommen.")))
