"""Pages (doc_id, page, raw) to cleaned pages: repairs, repeated edges, register pages, warnings.

Defined results: a null text is an empty page; pages without a doc_id are one document; repeated pages are pages each; equal page numbers
are ordered by their texts; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.functions import pagetext
from normlake.functions import text as T
from normlake.functions.pagetext import EDGE, EDGE_PAGES
from normlake.session import ensure_code

#: Documents whose pages are Python objects at once.
AT_ONCE = 64


def _edges(lines: Column) -> Column:
    both = F.array_distinct(F.concat(F.slice(lines, 1, EDGE), F.slice(lines, F.greatest(F.size(lines) - (EDGE - 1), F.lit(1)), EDGE)))
    return F.array_distinct(F.filter(F.transform(both, T.line_form), lambda x: F.length(x).between(1, 80)))


def repeated(forms: Column, n_pages: Column) -> Column:
    """The forms that come `least` times or more among `forms`, where least is half of the pages and three at least.

    Sorted, such a form takes up `least` neighbouring places, so one of the places least, 2 x least, ...: twelve at most, as a page has six forms.
    """
    least = F.greatest(F.lit(3), F.ceil(n_pages / 2)).cast("int")
    places = lambda f: F.sequence(F.lit(1), F.floor(F.size(f) / least).cast("int"))
    some = lambda f: F.array_distinct(F.transform(places(f), lambda k: F.element_at(f, k * least)))
    often = lambda f: F.filter(some(f), lambda x: F.size(F.filter(f, lambda y: y == x)) >= least)
    none = F.array().cast("array<string>")
    return F.when(n_pages < EDGE_PAGES, none).otherwise(T.let(F.sort_array(forms), lambda f: F.when(F.size(f) >= least, often(f)).otherwise(none)))


def repeated_edges(pages: DataFrame, text: str = "body") -> DataFrame:
    """doc_id, junk: forms of edge lines that at least half of a document's pages (three at least) have; documents without any have no row."""
    found = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.flatten(F.collect_list(_edges(F.split(text, "\n", -1)))).alias("forms"))
    return found.select("doc_id", repeated(F.col("forms"), F.col("n_pages")).alias("junk")).where(F.size("junk") > 0)


def _led(lines: Column, junk: Column) -> Column:
    """How many of the first EDGE lines go: blank or junk ones, up to the first that stays."""
    step = lambda acc, x: F.when(acc["go"] & ((T.line_form(x) == "") | F.array_contains(junk, T.line_form(x))), F.struct((acc["n"] + 1).alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(acc["n"].alias("n"), F.lit(False).alias("go")))
    return F.aggregate(F.slice(lines, 1, EDGE), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), step, lambda acc: acc["n"])


def without_edges(lines: Column, junk: Column) -> Column:
    top = F.slice(lines, _led(lines, junk) + 1, F.greatest(F.size(lines), F.lit(1)))
    return F.array_join(F.slice(top, 1, F.size(top) - _led(F.reverse(top), junk)), "\n")


def clean_documents(pages: DataFrame) -> DataFrame:
    """doc_id, pages: a row for each document, its cleaned pages in order as (page, body, small, register); body and small print are empty on register pages.

    A document is a book: bounded, and the unit of what repeats on its pages and of the sentences that run over them. So its pages meet
    once, in one exchange, and every later step is within the row, on plain strings: Spark works out functions over arrays one object at a
    time, without generated code, which took most of a query's time. Pages whose doc_id is null are one document.
    """
    ensure_code(pages.sparkSession)
    books = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page", "raw")).alias("p"))
    number = books.schema["p"].dataType.elementType["page"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                b = batch.slice(at, AT_ONCE)
                of, each = b.column(1).offsets.to_pylist(), b.column(1).values
                of, each = [k - of[0] for k in of], each.slice(of[0], of[-1] - of[0])
                rows = list(zip(each.field("page").to_pylist(), each.field("raw").to_pylist()))
                made = [x for a, z in zip(of, of[1:]) for x in pagetext.document(rows[a:z])]
                types = [each.type.field("page").type, pa.string(), pa.string(), pa.bool_()]
                fields = [pa.array(v, t) for v, t in zip(zip(*made) if made else [[]] * 4, types)]
                cleaned = pa.StructArray.from_arrays(fields, names=["page", "body", "small", "register"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(of, pa.int32()), cleaned)], names=["doc_id", "pages"])

    return books.mapInArrow(run, f"doc_id {books.schema['doc_id'].dataType.simpleString()}, pages array<struct<page:{number},body:string,small:string,register:boolean>>")


def clean_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page, body, small, register: the pages of clean_documents()."""
    return clean_documents(pages).select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")


def register_warnings(clean: DataFrame) -> DataFrame:
    """doc_id, message: a line for each document with register pages."""
    found = clean.where("register").groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("p"))
    many = F.concat(F.size("p").cast("string"), F.lit(" Seiten im Bereich "), F.col("p")[0].cast("string"), F.lit("–"), F.element_at("p", -1).cast("string"), F.lit("."))
    few = F.concat(F.lit("Seite "), F.array_join(F.transform("p", lambda x: x.cast("string")), ", "), F.lit("."))
    return found.select("doc_id", F.concat(F.lit("Verzeichnis-Seiten erkannt und ignoriert (Gesetzes-/Sachregister): "), F.when(F.size("p") > 2, many).otherwise(few)).alias("message"))


def scanned(pages: DataFrame) -> DataFrame:
    """doc_id, scanned: documents with under 20 characters a page have no usable text."""
    return pages.groupBy("doc_id").agg((F.sum(F.length(T.trimmed(F.coalesce("raw", F.lit(""))))) < 20 * F.count(F.lit(1))).alias("scanned"))
