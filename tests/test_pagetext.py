"""Plain-string cleaning against the column functions of the same names, over odd texts; how often a page passes through Spark's interpreted functions."""

import random

from pyspark.sql import functions as F

from normlake.functions import grammar, pagetext
from normlake.functions import text as T
from normlake.operators import cleaning

PIECES = [
    "Haus", "der", "gilt", "§ 5 BGB", "Seite", "12", "7", "Straße", "Ände-", "- \n", "a-\nb", "x-\nY", "ä-\n ö", " ", "­", " ", "​", "﻿", "ﬁnden", "½", "\x0b", "\f", "\r", "\t", "  ",
    "Rn.", "12a,", "kleine wörter stehen immer hier", "\n", "\n 12 \n", "5\u0085\n", " ", "İ", "\U0001d400", "ǅ", "\x85", "\x1c", "١٢", "Fn.", ".....", "\n" + T.FOOTNOTE_MARK, "\x05\x06\x07", "ende.",
]


def texts(n: int) -> list[str]:
    r = random.Random(3)
    made = [" ".join(r.choice(PIECES) for _ in range(r.randint(0, 25))) for _ in range(n)]
    made += ["\n".join(f"§ {r.randint(1, 99)} {r.choice(['ff.', 'Rn. 5', '12,', 'dieser satz ist sicher keine zeile des registers'])}" for _ in range(r.randint(8, 20))) for _ in range(n // 4)]
    made += [t * 2 for t in made[:40]] + ["".join(chr(ord(c) - 0x1D) if 32 <= ord(c) < 127 else c for c in "Grundlagen des Rechts gelten hier fuer alle, so steht es da. " * k) for k in (1, 2, 3)]
    return ["", *made]


def test_strings_are_cleaned_as_columns_are(spark):
    given = texts(400)
    df = spark.createDataFrame(list(enumerate(given)), "k int, t string")
    same = {"unshifted": T.unshifted, "single_layer": T.single_layer, "without_running_header": T.without_running_header, "without_bare_numbers": T.without_bare_numbers, "line_form": T.line_form, "tidied": T.cleaned, "register_like": T.register_like}
    rows = df.select("k", *(f(F.col("t")).alias(n) for n, f in same.items())).orderBy("k").collect()
    for name in same:
        assert [getattr(pagetext, name)(t) for t in given] == [r[name] for r in rows], name
    assert 10 < sum(r["register_like"] for r in rows) < 100 and any(r["unshifted"] != t for r, t in zip(rows, given)) and any(r["single_layer"] != t for r, t in zip(rows, given))


def test_pages_are_not_cleaned_by_interpreted_functions(spark):
    pages = spark.createDataFrame([(1, 1, "§ 1 BGB")], "doc_id int, page int, raw string")
    plan = cleaning.clean_documents(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "transform(" not in plan and "lambda" not in plan


def test_register_pages_of_a_long_book():
    register = "\n".join(f"§ {k} 12, 13" for k in range(1, 22))
    made = pagetext.document([(k, register) for k in range(40, 0, -1)])
    assert [p[0] for p in made] == list(range(1, 41)) and [p[3] for p in made] == [k - 1 >= 30 for k in range(1, 41)]


def test_details_are_tried_where_they_can_begin(monkeypatch):
    """Each try of a lexeme costs; a citation without details tried eleven before it gave up, and again at each blank."""
    tried = []
    take = grammar.Cursor.take
    monkeypatch.setattr(grammar.Cursor, "take", lambda self, lexeme: tried.append(lexeme) or take(self, lexeme))
    (_, _, found, _), = grammar.citations("Nach § 5 gilt das hier.")
    assert [c.norm.number for c in found] == ["5"] and len(tried) < 16
