"""Cleaning, checks, report, staleness, classifier, highlighting, sources, stream."""

import json

from normlake.functions import text as T
from normlake.operators import ai, citations, cleaning, highlight, registry, report, staleness
from normlake.sources import laws, pages
from normlake.streaming import documents
from pyspark.sql import functions as F


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first().y


def known(spark, slugs=None):
    return registry.sized(registry.dictionary(spark, slugs))


def extract(spark, *raw, **options):
    df = spark.createDataFrame([(1, k + 1, x) for k, x in enumerate(raw)], "doc_id bigint, page int, raw string")
    return citations.extract(cleaning.clean_pages(df), known(spark), **options)


def found(spark, *raw, **options):
    return [(r.canonical, r.page, r.law_key) for r in extract(spark, *raw, **options).orderBy("chain_no", "ref_no").collect()]


def test_cleaning_columns(spark):
    assert one(spark, T.cleaned, "ﬁnden Ver-\ntrag EU-\nRecht  x­y ²") == "finden Vertrag EU-Recht xy 2"
    assert one(spark, T.without_bare_numbers, "a\n 12 \nb\n12345") == "a\nb\n12345"
    assert one(spark, T.without_running_header, "II. Haftung 343\nText hier.") == "Text hier."
    assert one(spark, T.without_running_header, "1 Haftung 3\n2 Vertrag 7\nx") == "1 Haftung 3\n2 Vertrag 7\nx"
    twice = "Dieser Text steht zweimal auf der Seite, weil eine Ebene doppelt ist, und er ist lang genug dafür, so.\n"
    assert one(spark, T.single_layer, twice * 2) == twice
    shifted = "".join(chr(ord(c) - 0x1D) for c in "Grundlagen des Rechts und seiner Quellen in Deutschland und Europa heute")
    assert one(spark, T.unshifted, shifted).startswith("Grundlagen des Rechts")
    assert one(spark, T.unshifted, "short") == "short"
    assert one(spark, T.stripped_xml, "<a>x</a> &amp;lt; &gt;\n y") == "x < > y"


def test_edges_go_from_four_pages_on(spark):
    make = lambda n: spark.createDataFrame([(1, k, f"Kopf {k}\nText nummer {'abcdef'[k]}\nFuß") for k in range(n)], "doc_id bigint, page int, raw string")
    assert [r.body for r in cleaning.clean_pages(make(4)).orderBy("page").collect()] == [f"Text nummer {x}" for x in "abcd"]
    assert all(r.body.endswith("Fuß") for r in cleaning.clean_pages(make(3)).collect())


def test_register_pages(spark):
    dense = "\n".join(f"§ {k} {k + 3}, {k + 9}" for k in range(20))
    rows = [(1, k, "Ein Satz mit vielen Worten steht auf dieser Seite, Nummer " + "abcdefghij"[k % 10] * (k + 1)) for k in range(1, 50)] + [(1, 50, dense), (2, 1, dense)]
    clean = cleaning.clean_pages(spark.createDataFrame(rows, "doc_id bigint, page int, raw string"))
    assert [(r.doc_id, r.page) for r in clean.where("register").collect()] == [(1, 50)]
    assert cleaning.register_warnings(clean).first().message.endswith("Seite 50.")


def test_checks(spark):
    """Each text is a document of its own."""
    want = {
        "§ 7 BGB1 gilt.": [("§ 7 BGB", "bgb")], "§ 5 NJW gilt.": [("§ 5", "[?]")], "§ 3 Abs. 1 Der Vertrag": [("§ 3 Abs. 1", "[?]")], "§ 3 Abs. 1 XYZG gilt": [("§ 3 Abs. 1 XYZG", "xyzg")],
        "§ 1 Das Handelsrecht": [("§ 1", "[Verweis]")], "§ 242 Rn. 5 sagt": [("§ 242", "[Verweis]")], "Brox/Walker, SchuldR, § 22, Rn. 58": [("§ 22", "[Verweis]")],
        "Schmidt, 5. Aufl. 1999, § 26 II 1 sagt": [("§ 26 Abs. 2 S. 1", "[Verweis]")], "§ 2501 BGB, Art. 2501 GG": [("Art. 2501 GG", "gg")], "nach § 823, 1000 Euro": [("§ 823", "[?]")],
        "§ 133, 157 BGB": [("§ 133 BGB", "bgb"), ("§ 157 BGB", "bgb")], "§ 4 Abs. 2 K gilt": [("§ 4 Abs. 2", "[?]")], "§ 4 Abs. 2 a.F., S. 12 sagt": [("§ 4 Abs. 2 a.F.", "[Verweis]")],
    }
    df = spark.createDataFrame([(k, 1, x) for k, x in enumerate(want)], "doc_id bigint, page int, raw string")
    got = {}
    for r in citations.extract(cleaning.clean_pages(df), known(spark)).orderBy("doc_id", "chain_no", "ref_no").collect():
        got.setdefault(r.doc_id, []).append((r.canonical, r.law_key))
    assert [got[k] for k in range(len(want))] == list(want.values())
    assert found(spark, "Nach § 12 Abs. 1 gilt", implicit_code="BGB") == [("§ 12 Abs. 1 BGB", 1, "bgb")]
    assert found(spark, "§ 242 BGB Rn. 5 sagt", drop_rn=True) == []


def test_pages_of_citations(spark):
    got = found(spark, "Anspruch aus § 823", "BGB, ferner § 5 HGB" + T.FOOTNOTE_MARK + "§ 6 ZPO", "und § 7 StGB.")
    assert got == [("§ 823 BGB", 1, "bgb"), ("§ 5 HGB", 2, "hgb"), ("§ 7 StGB", 3, "stgb"), ("§ 6 ZPO", 2, "zpo")]


def test_registry_order(spark):
    slugs = spark.createDataFrame(list(enumerate(["bgb", "b_rsg_2007", "xlaw_1990", "xlaw_2018", "sgb_1", "sgb_5"])), "ordinal int, slug string")
    codes = ["BGB", "BörsG", "XLaw", "SGB", "SGB V", "Nichts", "", None, "NJW", "VOB/B", "GDPR"]
    got = registry.resolve(spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "k int, code string"), known(spark, slugs), "code").orderBy("k").collect()
    assert [r.slug for r in got][:4] == ["bgb", "b_rsg_2007", "xlaw_2018", "sgb_5"]
    assert [r.verdict for r in got][5:9] == ["unknown", "unknown", None, "reject"] and got[9].work_kind and got[10].display == "DSGVO"


def rows_of(spark, *raw):
    return report.group(extract(spark, *raw))


def test_report(spark):
    rows = rows_of(spark, "§§ 812–822 BGB und § 815 Abs. 1 BGB.", "§ 815 BGB, § 814 f. BGB.", "§ 800 ff. BGB, §§ 1–100 HGB.")
    got = {r.row_key: r for r in report.view(rows).collect()}
    assert got["bgb § 815"].pages == [1, 2] and got["bgb § 815"].implied_pages == [3] and got["bgb § 815"].pages_text == "1, 2, 3*"
    assert got["bgb § 815"].variants == ["§ 815 Abs. 1 BGB", "§ 815 BGB"]
    assert {k: v for k, v in got["bgb § 815"].page_sources.items()} == {1: ["§ 815 Abs. 1 BGB.", "§§ 812–822 BGB"], 2: ["§ 815 BGB", "§ 814 f. BGB."], 3: ["§ 800 ff. BGB"]}
    assert got["bgb § 814"].ff == "f." and got["bgb § 814"].implied_pages == [1, 3]
    assert {k: r.bucket for k, r in got.items()} == {"bgb § 812-822": "review", "bgb § 815": "main", "bgb § 814": "main", "bgb § 800 ff.": "review", "hgb § 1-100": "review"}
    shown = report.ranked(report.view(rows))
    csv = report.to_csv(shown).first().file
    assert csv.startswith("﻿" + report.CSV_HEADER + "\r\ngeprüft;BGB;§ 814;") and not csv.endswith("\n")
    assert "## Bereichszitate" in report.to_markdown(shown, F.lit("T")).first().file and "<h2>" in report.to_html(shown, F.lit("a<b")).first().file
    assert one(spark, T.csv_field, 'a;"b"') == '"a;""b"""' and one(spark, report.file_base, "x.PDF") == "x"


def test_verdicts(spark):
    rows = rows_of(spark, "§ 5 BGB gilt. Nach § 5 Abs. 2 hier.", "Nach § 6 Abs. 1 hier, nach § 7 Abs. 1 hier, nach § 8 Abs. 3 hier.")
    results = spark.createDataFrame([(1, "[?] § 5", "norm", "BGB", None), (1, "[?] § 6", "norm", "HGB", None), (1, "[?] § 7", "verweis", None, "Brox"), (1, "[?] § 8", "norm", "unbekannt", None)], "doc_id bigint, row_key string, typ string, gesetz string, werk string")
    got = report.view(report.merge_verdicts(rows, results)).collect()
    by = {(r.law, r.number): r for r in got}
    assert len(got) == 4 and by["BGB", "5"].variants == ["§ 5 BGB", "§ 5 Abs. 2"] and by["BGB", "5"].ai_pages == []
    assert by["HGB", "6"].ai_pages == [2] and by["HGB", "6"].pages_text == "2**" and by["HGB", "6"].ai_class == "norm"
    assert (by["[?]", "7"].bucket, by["[?]", "7"].werk) == ("literatur", "Brox") and by["[?]", "8"].ai_class == "unsicher"


def test_staleness(spark):
    norm = lambda n, t: f"<norm><enbez>§ {n}</enbez><textdaten><p>{t}</p></textdaten></norm>"
    head = "<norm><standkommentar>zuletzt geändert v. 3. 5.2020</standkommentar></norm>"
    versions = spark.createDataFrame([("bgb", "then", "2010-01-01", False, norm(1, "a") + norm(2, "b") + norm(10, "k"), "ok"), ("bgb", "now", "2025-01-01", True, head + norm(1, "a") + norm(2, "c") + norm(3, "neu") + norm(10, "k"), "ok")], "slug string, sha string, commit_ts string, is_current boolean, xml string, fetch_state string").withColumn("commit_ts", F.col("commit_ts").cast("timestamp"))
    rows = rows_of(spark, "§ 1 BGB, § 2 BGB, § 3 BGB, § 4 BGB, §§ 1–2 BGB, § 1 ff. BGB, §§ 1–100 BGB, § 9 AGBG, § 5 HGB, § 7 VOB/B, Art. 6 DSGVO, § 8 XYZG, § 1 f. BGB, §§ 2–1 BGB.")
    got = {r.row_key: r for r in staleness.check(rows, known(spark), versions, 2015).collect()}
    status = {k: r.status for k, r in got.items()}
    assert [status[f"bgb § {k}"] for k in ("2", "3", "4", "1-2", "1 ff.", "1-100", "2-1")] == ["PARA_CHANGED", "PARA_CHANGED", "LAW_CHANGED", "PARA_CHANGED", "LAW_CHANGED", "LAW_CHANGED", "LAW_CHANGED"]
    assert status["bgb § 1"] == "PARA_CHANGED" and "geändert: § 2" in got["bgb § 1"].note
    assert status["agbg § 9"] == "UNKNOWN" and status["hgb § 5"] == "UNKNOWN" and "Klauselwerk" in got["vob/b § 7"].note and status["xyzg § 8"] == "UNKNOWN"
    assert {r.row_key: r.status for r in staleness.check(rows, known(spark), versions, 2000).collect()}["agbg § 9"] == "PARA_CHANGED"
    assert one(spark, laws.last_amended, head) == "2020-05-03" and one(spark, T.german_date, "2020-05-03") == "3.5.2020"


def test_articles_as_sections(spark):
    xml = "<gliederungsbez>Art 246a</gliederungsbez><norm><enbez>§ 1</enbez><textdaten>x</textdaten></norm><gliederungsbez>Art 247</gliederungsbez>y"
    got = {(r.kind, r.number): r.text for r in laws.norms(spark.createDataFrame([("l", "s", xml)], "slug string, sha string, xml string")).collect()}
    assert got["§", "1"] == "x" and got["Art.", "246a"].endswith("x") and got["Art.", "247"] == "y"


def test_classifier(spark):
    raw = ("Nach BGB und § 5 Abs. 2 hier, § 9 BGB.", "Nach § 6 Abs. 1 dort.")
    df = spark.createDataFrame([(1, k + 1, x) for k, x in enumerate(raw)], "doc_id bigint, page int, raw string")
    clean = cleaning.clean_pages(df)
    c = citations.extract(clean, known(spark))
    rows = report.group(c)
    cases = ai.cases(rows, c, citations.joined_text(clean))
    assert "»§ 5 Abs. 2«" in cases.orderBy("rank").first().context
    asked = ai.prompts(ai.batched(cases, 1), ai.candidate_laws(rows), "BGB")
    assert asked.count() == 2
    got = {r.row_key: r.typ for r in ai.answers(ai.classify(asked, ai.offline)).collect()}
    assert got == {"[?] § 5": "norm", "[?] § 6": "norm"}

    def broke(prompt):
        raise ai.QuotaExceeded

    assert ai.answers(ai.classify(asked, broke)).count() == 0
    odd = spark.createDataFrame([(1, 0, ["k"], json.dumps({"ergebnisse": [{"nr": 9, "typ": "norm"}, {"nr": 1, "typ": "x"}, {"nr": 1, "typ": "verweis", "werk": "W"}]})), (1, 1, ["k"], "no json")], "doc_id bigint, batch int, keys array<string>, answer string")
    assert [tuple(r) for r in ai.answers(odd).collect()] == [(1, "k", "verweis", None, "W")]


def test_highlight(spark):
    items = spark.createDataFrame([(1, 1, k, s) for k, s in enumerate(["Nach § 8", "23 Abs. 1", "", " BGB gilt", "aaa"])], "doc_id bigint, page int, item_no int, str string")
    targets = lambda *t: spark.createDataFrame([(1, 1, x) for x in t], "doc_id bigint, page int, target string")
    hits = lambda *t: sorted(r.item_no for r in highlight.hits(items, targets(*t)).collect())
    assert hits("§ 823 Abs.1 BGB") == [0, 1, 3] and hits("x", "zz") == [] and hits("aa") == [4]


def test_items(spark):
    rows = [(0, "Der Körper der Seite ist groß", True, 10.0), (1, "und lang.", True, 10.0), (2, "1 Fußnote", True, 7.0), (3, "Mehr Körper", False, None)]
    items = spark.createDataFrame([(1, 1, *r, [0.0, 0.0, 0.0, 10.0, 0.0, 0.0]) for r in rows], "doc_id bigint, page int, item_no int, str string, has_eol boolean, height double, transform array<double>")
    assert pages.body_first_pages(items).first().raw == "Der Körper der Seite ist groß\nund lang.\nMehr Körper" + T.FOOTNOTE_MARK + "1 Fußnote"
    assert pages.plain_pages(items).first().raw == "Der Körper der Seite ist groß\nund lang.\n1 Fußnote\nMehr Körper"


def test_sources(spark):
    toc = spark.createDataFrame([("".join(f"<link>https://host/law_{k}/xml.zip</link>" for k in range(1200)),)], "value string")
    assert laws.slugs(toc).count() == 1200
    listing = spark.createDataFrame([("a", 0, "x.txt"), ("a", 1, "b.xml"), ("a", 2, "c.xml")], "slug string, position int, name string")
    assert laws.xml_files(listing).first().name == "b.xml"
    cache = spark.createDataFrame([("k", "2024-01-01", "v"), ("l", "2024-01-09", "w")], "key string, stored_ts string, value string").withColumn("stored_ts", F.col("stored_ts").cast("timestamp"))
    assert [r.key for r in laws.cached(cache, F.lit("2024-01-10").cast("timestamp"), "slugs").collect()] == ["l"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, [f"Nach § {k + 1} BGB gilt.", f"Und § {k + 2}", "HGB."]) for k in range(5)]
    spark.createDataFrame(rows, documents.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = documents.start(documents.read(spark, str(tmp_path / "in")), known(spark), documents.to_parquet(str(tmp_path / "out")), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = sorted((r.doc_id, r.page, r.canonical) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(x for k in range(5) for x in ((k, 1, f"§ {k + 1} BGB"), (k, 2, f"§ {k + 2} HGB")))
