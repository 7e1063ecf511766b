"""Odd and empty tables, sinks, sources that fail, classifiers that refuse, broadcasts, the shared folder."""

import duckdb  # noqa: F401  (the other tests need it; here its absence shows early)
import pytest
from normlake import session
from normlake.functions import text as T
from normlake.operators import ai, audits, citations, cleaning, registry, report, staleness
from normlake.sources import laws, pages
from pyspark.sql import functions as F

PAGES = "doc_id {}, page int, raw string"


def known(spark):
    return registry.sized(registry.dictionary(spark))


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    where = spark.conf.get("spark.checkpoint.dir")

    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session)
    Context.master = "local[4]"
    assert session.shared_dir(Session) and session.shared_dir(spark) == where.rstrip("/")


def test_what_is_materialized_can_be_dropped(spark):
    point = session.mark(spark)
    a, b, c = (session.materialize(spark.range(k)) for k in (1, 2, 3))
    session.drop(a)
    assert session.mark(spark) == point + 2
    session.drop_since(spark, point, keep=1)
    assert session.mark(spark) == point + 1 and c.count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.schema("id bigint").parquet(b._normlake_path).count()
    session.drop(c)


def test_broadcast_is_a_matter_of_the_frame(spark):
    codes = spark.createDataFrame([("BGB",)], "code string")
    plan = lambda k: registry.resolve(codes, k, "code")._jdf.queryExecution().optimizedPlan().toString()
    d = registry.dictionary(spark)
    assert "broadcast" in plan(registry.sized(d)) and "broadcast" not in plan(registry.sized(d, 3)) and "broadcast" not in plan(d)


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_documents_with_any_ids(spark, kind):
    """Ids of any type; pages without an id are one document; null and empty pages are empty."""
    ids = [1, 1, 2, None, None] if kind == "bigint" else ["a", "a", "b", None, None]
    raw = ["Nach § 7 AO gilt,", None, "", "dann § 8", "ZPO ferner."]
    df = spark.createDataFrame([(i, k + 1, r) for k, (i, r) in enumerate(zip(ids, raw))], PAGES.format(kind))
    got = citations.extract(cleaning.clean_documents(df), known(spark))
    assert sorted((str(r.doc_id), r.page, r.canonical) for r in got.collect()) == sorted([(str(ids[0]), 1, "§ 7 AO"), ("None", 4, "§ 8 ZPO")])
    rows = report.group(got)
    assert sorted(str(r.doc_id) for r in rows.collect()) == sorted([str(ids[0]), "None"])


def test_empty_tables(spark):
    clean = cleaning.clean_documents(spark.createDataFrame([], PAGES.format("bigint")))
    found = citations.extract(clean, known(spark))
    rows = report.group(found)
    shown = report.ranked(report.view(rows))
    versions = spark.createDataFrame([], "slug string, sha string, commit_ts timestamp, is_current boolean, xml string, fetch_state string")
    assert [f.count() for f in (found, rows, report.to_csv(shown), report.covering(found), audits.warnings(clean, found), audits.progress(found, clean), audits.snippets(rows), staleness.check(rows, known(spark), versions, 2015))] == [0] * 8


def test_escapes(spark):
    row = [(1, "k", "a|<b>", "§", "1", None, None, ["x|y", "p & q"], [1], [], [], True, None, None, "UNKNOWN", 'say "a;b" | <i>')]
    rows = spark.createDataFrame(row, "doc_id int, row_key string, law string, kind string, number string, number_end string, ff string, variants array<string>, pages array<int>, implied_pages array<int>, ai_pages array<int>, implicit_only boolean, ai_class string, werk string, status string, note string")
    shown = report.view(rows)
    line = lambda of: of(shown).first().line
    assert line(report.md_lines) == '| a\\|<b> *(implizit)* | § 1 | x\\|y; p & q | 1 | nicht geprüft | say "a;b" \\| <i> |'
    assert "<td>a|&lt;b&gt; <em>(implizit)</em></td>" in line(report.html_lines) and "p &amp; q" in line(report.html_lines) and "&lt;i&gt;" in line(report.html_lines)
    assert line(report.csv_lines).endswith(';nicht geprüft;"say ""a;b"" | <i>"')


def test_files_are_written(spark, tmp_path):
    files = spark.createDataFrame([(1, "\ufeffä;b\r\nc"), (2, "x"), (3, "y"), (None, "z")], "doc_id int, file string")
    names = spark.createDataFrame([(1, "Buch.PDF"), (2, "same"), (3, "same")], "doc_id int, title string")
    got = {r.name: r.bytes for r in report.save(files, names, f"file://{tmp_path}/out", "csv").collect() if r.name}
    assert sorted(got) == ["Buch-normen.csv", "same-2-normen.csv", "same-3-normen.csv"]
    assert (tmp_path / "out" / "Buch-normen.csv").read_bytes() == "\ufeffä;b\r\nc".encode()


def test_files_are_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Seite eins\fSeite § 2\f")
    (tmp_path / "in" / "b.txt").write_text("nur eine")
    assert sorted(map(tuple, pages.read_text(spark, str(tmp_path / "in")).collect())) == [("a.txt", 1, "Seite eins"), ("a.txt", 2, "Seite § 2"), ("b.txt", 1, "nur eine")]
    (tmp_path / "items.json").write_text('{"doc_id": "a", "page": 1, "item_no": 0, "str": "x", "has_eol": true}\nnot json\n')
    assert [(r.doc_id, r.str, r.height) for r in pages.read_items(spark, str(tmp_path / "items.json")).collect()] == [("a", "x", None)]


def test_sources_that_fail(spark, tmp_path):
    def get(slug, sha):
        if slug == "limited":
            return 429, "no"
        if slug == "raised":
            raise laws.RateLimited
        if slug == "broken":
            raise KeyError(slug)
        return (200, f"<{sha}>") if slug == "ok" else (404, "none")

    wanted = spark.createDataFrame([("ok", "1"), ("ok", "1"), ("limited", "2"), ("raised", "3"), ("broken", "4"), ("missing", "5")], "slug string, sha string")
    got = {r.slug: (r.xml, r.fetch_state) for r in laws.fetched(wanted, get).collect()}
    assert got == {"ok": ("<1>", "ok"), "limited": (None, "rate_limited"), "raised": (None, "rate_limited"), "broken": (None, "error"), "missing": (None, "error")}
    at, entries = str(tmp_path / "cache"), lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    laws.store(entries("old"), at, F.lit("2024-01-01"))
    laws.store(entries("new"), at, F.lit("2024-01-03"))
    look = lambda now: [r.value for r in laws.lookup(spark, at, F.lit(now).cast("timestamp"), "slugs").collect()]
    assert look("2024-01-09") == ["new"] and look("2024-03-01") == []


def test_slugs_over_several_rows(spark):
    toc = spark.createDataFrame([("<a>h/sgb_2/xml.zip</a>",), ("<b>h/sgb_1/xml.zip h/sgb_2/xml.zip</b>",)], "value string")
    assert [tuple(r) for r in laws.slugs(toc, 1).orderBy("ordinal").collect()] == [(0, "sgb_2"), (1, "sgb_1")]
    with pytest.raises(ValueError, match="broken"):
        laws.slugs(toc)


def test_classifiers_that_refuse(spark):
    asked = spark.createDataFrame([(1, k, f"p{k}", ["x"]) for k in range(3)], "doc_id bigint, batch int, prompt string, keys array<string>").coalesce(1)

    def spent(prompt):
        if prompt != "p0":
            raise ai.QuotaExceeded
        return "first"

    def busy(prompt, seen=[]):  # noqa: B006
        seen.append(prompt)
        if len(seen) % 2:
            raise ai.Refused(0.1)
        return "second"

    def down(prompt):
        raise OSError

    def refused(prompt):
        raise ai.Refused

    ask = lambda *a: [r.answer for r in ai.classify(asked, list(a), sleep=lambda s: None).orderBy("batch").collect()]
    assert ask(spent, busy) == ["first", "second", "second"] and ask(down) == [None] * 3 and ask(refused, spent) == ["first", None, None] and ask() == [None] * 3
    assert ai.ANSWER["properties"]["ergebnisse"]["items"]["properties"]["typ"]["enum"] == list(ai.KINDS) and all(k in ai.SYSTEM for k in ai.KINDS)


def test_recall_of_a_register(spark):
    df = spark.createDataFrame([(1, 1, "Nach §§ 10–20 AO und § 30 Abs. 2 gilt das.")], PAGES.format("bigint"))
    found = citations.extract(cleaning.clean_documents(df), known(spark))
    gold = spark.createDataFrame([(1, "ao", "§", k) for k in (10, 15, 30, 40, None)], "doc_id bigint, law_key string, kind string, num_int int")
    assert {r.num_int: r.hit for r in audits.register_hits(gold, found).collect()} == {10: "law", 15: "law", 30: "ambiguous", 40: "miss", None: "miss"}


def test_cleaning_of_odd_characters(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one(T.trimmed, "\u00a0\u2003 é x\u3000\t") == "é x" and one(T.single_blanks, "a\u00a0b  c\n\td e") == "a b c d e" and one(T.nfkc, None) is None
    assert one(T.nfkc, "ﬁ é ²") == "fi é 2"


def test_repeated_edges_threshold(spark):
    """A line goes if half of the pages have it, three at least, from four pages on."""
    cases = [(n, k) for n in (3, 4, 5, 6, 7, 9) for k in range(1, n + 1)]
    rows = [(100 * n + k, p, f"Kopf\nText {'abcdefghi'[p]}" if p < k else f"Text {'abcdefghi'[p]}") for n, k in cases for p in range(n)]
    clean = {r.doc_id: r.pages[0].body for r in cleaning.clean_documents(spark.createDataFrame(rows, PAGES.format("bigint"))).collect()}
    for n, k in cases:
        assert ("Kopf" in clean[100 * n + k]) == (n < 4 or k < max(3, -(-n // 2))), (n, k)
