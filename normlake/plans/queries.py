"""Queries over the star schema and their SQL: texts are built from columns, go through the operators, and must give back the columns.

Expressions named here run in Spark and in the oracle's engine alike, so that both build the same corpus; expected values come from the
columns, never from a second parser.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.functions import text as T
from normlake.operators import ai, audits, citations, cleaning, highlight, registry, report, staleness
from normlake.sources import laws, pages

BASE = (
    "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS INT) AS page, CAST(l_partkey % 2385 + 1 AS INT) AS n, CAST(l_suppkey % 19 + 1 AS INT) AS l, CAST(l_suppkey % 6 AS INT) AS k, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, "
    "CASE l_suppkey % 5 WHEN 0 THEN 'BGB' WHEN 1 THEN 'HGB' WHEN 2 THEN 'StGB' WHEN 3 THEN 'ZPO' ELSE 'AktG' END AS code, CASE l_partkey % 4 WHEN 0 THEN 'II' WHEN 1 THEN 'IV' WHEN 2 THEN 'IX' ELSE 'XIV' END AS roman, "
    "CASE l_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 9 ELSE 14 END AS value FROM lineitem"
)
#: A sentence long enough that lines are never taken for repeated headers.
FILL = "Dieser Satz dient allein dazu, die Zeile länger als achtzig Zeichen werden zu lassen, mehr nicht."
#: What a sentence begins with, so that no page begins with what comes again on it.
OPENING = "'Aus Teil ' || CAST(part AS STRING) || ' von ' || CAST(supp AS STRING) || ' zu ' || CAST(price AS STRING) || ' folgt hier: '"
S = "CAST({} AS STRING)".format
N, L = S("n"), S("l")
#: name: sentence, [(canonical, law key, verweis)]
FORMS: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "cite_basic": (f"'Nach § ' || {N} || ' Abs. ' || {L} || ' ' || code || ' gilt das hier.'", [(f"'§ ' || {N} || ' Abs. ' || {L} || ' ' || code", "lower(code)", "false")]),
    "cite_roman": (f"'Nach § ' || {N} || ' ' || roman || ' ' || {L} || ' ' || code || ' gilt das hier.'", [(f"'§ ' || {N} || ' Abs. ' || {S('value')} || ' S. ' || {L} || ' ' || code", "lower(code)", "false")]),
    "cite_enum": (
        f"'Nach §§ ' || {N} || ', ' || {S('n + 7')} || ' Abs. ' || {L} || ' und ' || {S('n + 110')} || ' ' || code || ' gilt das hier.'",
        [(f"'§ ' || {N} || ' ' || code", "lower(code)", "false"), (f"'§ ' || {S('n + 7')} || ' Abs. ' || {L} || ' ' || code", "lower(code)", "false"), (f"'§ ' || {S('n + 110')} || ' ' || code", "lower(code)", "false")],
    ),
    "cite_range_ff": (
        f"'Nach §§ ' || {N} || '–' || {S('n + 9')} || ' ' || code || ' sowie § ' || {N} || ' ff. ' || code || ' gilt das hier.'",
        [(f"'§§ ' || {N} || '–' || {S('n + 9')} || ' ' || code", "lower(code)", "false"), (f"'§ ' || {N} || ' ff. ' || code", "lower(code)", "false")],
    ),
    "cite_ivm_propagation": (
        f"'Nach § ' || {N} || ' Abs. ' || {L} || ' i. V. m. ' || {S('n + 3')} || ' ' || code || ' gilt das hier.'",
        [(f"'§ ' || {N} || ' Abs. ' || {L} || ' ' || code", "lower(code)", "false"), (f"'§ ' || {S('n + 3')} || ' ' || code", "lower(code)", "false")],
    ),
    "cite_details": (
        f"'Nach § ' || {N} || ' Absatz ' || {L} || ' Satz 2 Halbsatz 1 Nr. ' || {L} || ' lit. b ' || code || ' gilt das hier.'",
        [(f"'§ ' || {N} || ' Abs. ' || {L} || ' S. 2 Hs. 1 Nr. ' || {L} || ' lit. b ' || code", "lower(code)", "false")],
    ),
    "cite_modifiers": (f"'Nach § ' || {N} || ' Abs. ' || {L} || ' ' || code || ' a.F. analog gilt das hier.'", [(f"'§ ' || {N} || ' Abs. ' || {L} || ' a.F. analog ' || code", "lower(code)", "false")]),
    "cite_eu": (
        f"'Nach Art. ' || {S('n % 99 + 1')} || ' Abs. ' || {L} || ' VO (EU) 2019/' || {S('n + 100')} || ' gilt das hier.'",
        [(f"'Art. ' || {S('n % 99 + 1')} || ' Abs. ' || {L} || ' VO (EU) 2019/' || {S('n + 100')}", f"'vo(eu)2019/' || {S('n + 100')}", "false")],
    ),
    "cite_egbgb": (f"'Nach Art. ' || {S('n % 250 + 1')} || 'a § ' || {L} || ' Abs. 2 EGBGB gilt das hier.'", [(f"'Art. ' || {S('n % 250 + 1')} || 'a § ' || {L} || ' Abs. 2 EGBGB'", "'egbgb'", "false")]),
    "cite_validation": (
        f"'Nach § ' || {N} || ' Abs. ' || {L} || ' ' || CASE k WHEN 0 THEN 'BGB1' WHEN 1 THEN 'NJW' WHEN 2 THEN 'Vertrag' WHEN 3 THEN 'XYZG' WHEN 4 THEN 'IV' ELSE 'Musterordnung' END || ' gilt das hier.'",
        [
            (
                f"CASE WHEN k = 4 THEN '§ ' || {N} || ' Abs. ' || {L} || ', 4' ELSE '§ ' || {N} || ' Abs. ' || {L} || CASE k WHEN 0 THEN ' BGB' WHEN 3 THEN ' XYZG' WHEN 5 THEN ' Musterordnung' ELSE '' END END",
                "CASE k WHEN 0 THEN 'bgb' WHEN 3 THEN 'xyzg' WHEN 5 THEN 'musterordnung' ELSE '[?]' END",
                "false",
            )
        ],
    ),
    "cite_verweis": (f"'Siehe Brox/Walker, SchuldR, § ' || {N} || ', Rn. 5.'", [(f"'§ ' || {N}", "'[Verweis]'", "true")]),
}
#: Twenty forms on one page, by `part % 20`: text, then what is cited, then its law, for each of up to two citations.
MIXED: list[tuple[str, list[tuple[str, str]]]] = [
    (f"'§ ' || {S('n + 2600')} || ' BGB'", []),
    (f"'Art. ' || {S('n + 2600')} || ' GG'", [(f"'Art. ' || {S('n + 2600')} || ' GG'", "gg")]),
    (f"'§ ' || {S('n + 10000')} || ' BGB'", []),
    (f"'§ ' || {N} || ' Rn. 5'", [(f"'§ ' || {N}", "[Verweis]")]),
    (f"'§ ' || {N} || ' A'", [(f"'§ ' || {N}", "[?]")]),
    (f"'§ ' || {N} || ' BGB Rn. 5'", [(f"'§ ' || {N} || ' BGB'", "bgb")]),
    (f"'§ ' || {N} || ' Der Anspruch'", [(f"'§ ' || {N}", "[Verweis]")]),
    (f"'§ ' || {N} || ' Abs. ' || {L} || ' a.F., S. 116'", [(f"'§ ' || {N} || ' Abs. ' || {L} || ' a.F.'", "[Verweis]")]),
    (f"'Kurz, 5. Aufl. 2001, § ' || {N} || ' Abs. ' || {L}", [(f"'§ ' || {N} || ' Abs. ' || {L}", "[Verweis]")]),
    (f"'§ ' || {N} || ', ' || {S('l + 30')} || ' Euro'", [(f"'§ ' || {N}", "[?]")]),
    (f"'§ ' || {N} || ', ' || {S('n + 7')} || ' HGB'", [(f"'§ ' || {N} || ' HGB'", "hgb"), (f"'§ ' || {S('n + 7')} || ' HGB'", "hgb")]),
    (f"'§ ' || {N} || ' Abs. ' || {L} || ', ' || {S('l + 1')} || ' und ' || {S('l + 2')} || ' S. 3 ZPO'", [(f"'§ ' || {N} || ' Abs. ' || {L} || ', ' || {S('l + 1')} || ' und ' || {S('l + 2')} || ' S. 3 ZPO'", "zpo")]),
    (f"'Art. ' || {S('n % 99 + 1')} || ' Abs. ' || {L} || ' lit. a, b und c) DSGVO'", [(f"'Art. ' || {S('n % 99 + 1')} || ' Abs. ' || {L} || ' lit. a, b und c DSGVO'", "dsgvo")]),
    (f"'§§ ' || {N} || ' Nr. 1, ' || {S('n + 100')} || ' HGB'", [(f"'§ ' || {N} || ' Nr. 1 HGB'", "hgb"), (f"'§ ' || {S('n + 100')} || ' HGB'", "hgb")]),
    (f"'§ ' || {N} || ' Abs. ' || {L} || ' bis 20 BGB'", [(f"'§ ' || {N} || ' Abs. ' || {L} || '-20 BGB'", "bgb")]),
    (f"'§ ' || {N} || ' (Güter) BGB'", [(f"'§ ' || {N} || ' BGB'", "bgb")]),
    (f"'§ ' || {N} || ' (Güter), § ' || {S('n + 1')} || ' ZPO'", [(f"'§ ' || {N}", "[?]"), (f"'§ ' || {S('n + 1')} || ' ZPO'", "zpo")]),
    (f"'§ ' || {N} || ' i.V.m. ' || {S('n + 1')} || ' Abs. 2 ZPO'", [(f"'§ ' || {N} || ' ZPO'", "zpo"), (f"'§ ' || {S('n + 1')} || ' Abs. 2 ZPO'", "zpo")]),
    (f"'§ ' || {N} || ' Abs. ' || {L} || ' S. 2, Abs. 3 StGB'", [(f"'§ ' || {N} || ' Abs. ' || {L} || ' S. 2 Abs. 3 StGB'", "stgb")]),
    (f"'§ ' || {N} || ' SGB V'", [(f"'§ ' || {N} || ' SGB V'", "sgbv")]),
]


def _case(values: dict[int, str], of: str = "part % 20") -> str:
    return f"CASE {of} {' '.join(f'WHEN {k} THEN {v}' for k, v in values.items())} END"


def _mixed(k: int) -> tuple[str, str, str]:
    found = {m: f[k] for m, (_, f) in enumerate(MIXED) if len(f) > k}
    return _case({m: c for m, (c, _) in found.items()}), _case({m: f"'{law}'" for m, (_, law) in found.items()}), _case({m: str(law == "[Verweis]").lower() for m, (_, law) in found.items()})


FORMS["cite_mixed"] = (f"'Nach ' || {_case({m: t for m, (t, _) in enumerate(MIXED)})} || ' gilt das hier.'", [_mixed(0), _mixed(1)])
# A Roman numeral behind an explicit paragraph is a detail of its own.
FORMS["cite_validation"][1][0] = (FORMS["cite_validation"][1][0][0].replace(" || ', 4'", " || ' Abs. 4'"), *FORMS["cite_validation"][1][0][1:])


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def _known(spark: SparkSession) -> DataFrame:
    return registry.sized(registry.dictionary(spark))


def corpus(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Pages (doc_id, page, raw): a document for each order, a page for each line number."""
    _views(spark, sf_dir, "lineitem")
    rows = spark.sql(f"SELECT doc_id, page, {OPENING} || {FORMS[form][0]} || ' {FILL}' AS sentence FROM ({BASE})")
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.array_sort(F.collect_list("sentence")), " ").alias("raw"))


def cited(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return citations.extract(cleaning.clean_documents(corpus(spark, sf_dir, form)), _known(spark))


def cite(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return cited(spark, sf_dir, form).groupBy("doc_id", "page", "canonical", "law_key", "verweis").agg(F.count(F.lit(1)).alias("n"))


def _cite_sql(form: str) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, page, {c} AS canonical, {k} AS law_key, {v} AS verweis FROM base" for c, k, v in FORMS[form][1])
    return f"WITH base AS ({BASE}) SELECT doc_id, page, canonical, law_key, verweis, count(*) AS n FROM ({parts}) WHERE canonical IS NOT NULL GROUP BY ALL"


# A row for each norm of the corpus cite_range_ff: its key, pages and pages implied by other citations.
_NORMS = f"""
WITH base AS ({BASE}),
c AS (SELECT doc_id, page, code, n, n + 9 AS high, 0 AS open FROM base UNION ALL SELECT doc_id, page, code, n, n + 20, 1 FROM base),
r AS (SELECT doc_id, code, n, open, list_sort(list(DISTINCT page)) AS pages FROM c GROUP BY ALL),
i AS (SELECT r.doc_id, r.code, r.n, r.open, list(DISTINCT c.page) AS implied FROM r JOIN c ON r.doc_id = c.doc_id AND r.code = c.code AND r.n BETWEEN c.n AND c.high AND NOT (r.n = c.n AND r.open = c.open) GROUP BY ALL),
rows AS (SELECT r.*, list_sort(list_filter(coalesce(implied, []), lambda x: NOT list_contains(pages, x))) AS implied FROM r LEFT JOIN i USING (doc_id, code, n, open)),
t AS (SELECT *, lower(code) || ' § ' || n || CASE open WHEN 0 THEN '-' || (n + 9) ELSE ' ff.' END AS row_key, CASE open WHEN 0 THEN '§§ ' || n || '–' || (n + 9) ELSE '§ ' || n || ' ff.' END AS label,
CASE open WHEN 0 THEN 'main' ELSE 'review' END AS bucket,
list_aggregate(list_transform(list_sort(list_transform(pages, lambda x: x * 10) || list_transform(implied, lambda x: x * 10 + 1)), lambda x: CAST(x // 10 AS VARCHAR) || CASE WHEN x % 10 = 1 THEN '*' ELSE '' END), 'string_agg', ', ') AS pages_text FROM rows)
"""


def norm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.group(cited(spark, sf_dir, "cite_range_ff"))


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def group_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_rows(spark, sf_dir).select("doc_id", "row_key", "law", _joined("pages").alias("pages"), F.array_join("variants", "|").alias("variants"), "implicit_only")


def implied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_rows(spark, sf_dir).where(F.size("implied_pages") > 0).select("doc_id", "row_key", _joined("implied_pages").alias("implied"))


def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked(report.view(norm_rows(spark, sf_dir)))


def report_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(spark, sf_dir).select("doc_id", "row_key", F.col("rank").cast("bigint").alias("rank"), "bucket", "label", "pages_text")


def export_lines(spark: SparkSession, sf_dir: str, lines: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return lines(report.view(norm_rows(spark, sf_dir))).select("doc_id", "row_key", "line")


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.to_csv(shown(spark, sf_dir)).select("doc_id", F.md5("file").alias("file"))


#: Codes probed, with what resolution says of them: verdict, display, slug.
PROBES = [
    ("BGB", "known", "BGB", "bgb"), ("B.G.B.", "known", "B.G.B.", "bgb"), ("stgb", "known", "stgb", "stgb"), ("NJW", "reject", None, None), ("EGBGB", "known", "EGBGB", "bgbeg"), ("Verordnung", "unknown", None, None),
    ("VOB/B", "known", "VOB/B", None), ("GDPR", "known", "DSGVO", None), ("VO (EU) 2019/1150", "known", "VO (EU) 2019/1150", None), ("AGBG", "known", "AGBG", None), ("Warenkauf-RL", "known", "Warenkauf-RL", None), ("XYZG", "unknown", None, None),
]


def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*(F.lit(p[0]) for p in PROBES))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.element_at(codes, (F.col("p_partkey") % len(PROBES) + 1).cast("int")).alias("code"))
    return registry.resolve(part, _known(spark), "code").select("p_partkey", "code", "verdict", "display", "slug")


def _registry_sql() -> str:
    q = lambda x: "NULL" if x is None else f"'{x}'"
    rows = ", ".join(f"({k}, {', '.join(q(x) for x in p)})" for k, p in enumerate(PROBES))
    return f"SELECT p_partkey, code, verdict, CAST(display AS VARCHAR) AS display, CAST(slug AS VARCHAR) AS slug FROM part JOIN (VALUES {rows}) t(k, code, verdict, display, slug) ON p_partkey % {len(PROBES)} = k"


def unresolved_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = citations.unresolved(cited(spark, sf_dir, "cite_validation"))
    return found.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders")
    versions = spark.sql("SELECT CAST(o_custkey AS STRING) AS slug, CAST(o_orderkey AS STRING) AS sha, timestampadd(MICROSECOND, o_orderkey, o_orderdate) AS commit_ts FROM orders")
    return laws.snapshot(versions, F.lit("1996-06-30"))


#: Laws of the synthetic corpus: slug, date of the last amendment, state of the source.
LAWS = [("bgb", "3. 5.2020", "ok"), ("hgb", "1. 6.2015", "ok"), ("stgb", "2.11.2001", "ok"), ("zpo", None, "ok"), ("aktg", None, "rate_limited")]
YEAR, NORMS = 2015, 60


def law_versions(spark: SparkSession) -> DataFrame:
    """Two versions of each law: norms 1 to NORMS; in the later one, text changes where 3 divides the number, and 7's multiples are new."""
    rows = spark.createDataFrame(LAWS, "slug string, amended string, state string").crossJoin(F.broadcast(spark.createDataFrame([(0,), (1,)], "now int")))
    norm = lambda i: F.when((F.col("now") == 1) | (i % 7 != 0), F.concat(F.lit("<norm><enbez>§ "), i.cast("string"), F.lit("</enbez><textdaten>Norm "), i.cast("string"), F.when((F.col("now") == 1) & (i % 3 == 0), " neu").otherwise(" alt"), F.lit("</textdaten></norm>"))).otherwise("")
    head = F.coalesce(F.concat(F.lit("<norm><standkommentar>Geändert d. G v. "), F.col("amended"), F.lit("</standkommentar></norm>")), F.lit(""))
    xml = F.when(F.col("state") == "ok", F.concat(head, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(NORMS)), norm), "")))
    return rows.select("slug", F.concat_ws("-", "slug", "now").alias("sha"), F.when(F.col("now") == 1, F.lit("2025-01-01")).otherwise("2010-01-01").cast("timestamp").alias("commit_ts"), (F.col("now") == 1).alias("is_current"), xml.alias("xml"), F.col("state").alias("fetch_state"))


def stale_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.group(cited(spark, sf_dir, "cite_stale"))
    return staleness.check(rows, _known(spark), law_versions(spark), YEAR).select("doc_id", "row_key", "status", "law_last_amended", "note")


FORMS["cite_stale"] = (f"'Nach § ' || {S('n % 70 + 1')} || ' Abs. ' || {L} || ' ' || code || ' gilt das hier.'", [(f"'§ ' || {S('n % 70 + 1')} || ' Abs. ' || {L} || ' ' || code", "lower(code)", "false")])
_STALE = f"""
WITH base AS ({BASE}), r AS (SELECT DISTINCT doc_id, code, n % 70 + 1 AS m FROM base)
SELECT doc_id, lower(code) || ' § ' || m AS row_key,
CASE code WHEN 'BGB' THEN CASE WHEN m > 60 THEN 'LAW_CHANGED' WHEN m % 3 = 0 OR m % 7 = 0 THEN 'PARA_CHANGED' ELSE 'PARA_UNCHANGED' END WHEN 'HGB' THEN 'POSSIBLY_STALE' WHEN 'AktG' THEN 'UNKNOWN' ELSE 'UNCHANGED' END AS status,
CASE code WHEN 'BGB' THEN '2020-05-03' WHEN 'HGB' THEN '2015-06-01' WHEN 'StGB' THEN '2001-11-02' END AS law_last_amended,
CASE code WHEN 'BGB' THEN CASE WHEN m > 60 THEN 'BGB zuletzt geändert 3.5.2020. (§ ' || m || ' dort nicht auffindbar – nur Gesetzesebene geprüft.)' WHEN m % 3 = 0 OR m % 7 = 0 THEN '§ ' || m || ' BGB wurde seit 2015 geändert!' ELSE 'BGB zuletzt geändert 3.5.2020. § ' || m || ' selbst ist textgleich zum Stand 2015.' END
WHEN 'HGB' THEN 'HGB wurde noch 1.6.2015 geändert – im Erscheinungsjahr selbst.' WHEN 'StGB' THEN 'StGB seit 2.11.2001 unverändert.' WHEN 'ZPO' THEN 'Keine Änderungsdaten für ZPO gefunden.' ELSE 'Prüfung nicht möglich (Abruflimit der Quelle erreicht – später erneut versuchen).' END AS note FROM r
"""


def law_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laws.norms(law_versions(spark)).select("slug", "sha", "kind", "number", "text")


_LAW_NORMS = f"""
SELECT slug, slug || '-' || now AS sha, '§' AS kind, CAST(i AS VARCHAR) AS number, 'Norm ' || i || CASE WHEN now = 1 AND i % 3 = 0 THEN ' neu' ELSE ' alt' END AS text
FROM (VALUES ('bgb'), ('hgb'), ('stgb'), ('zpo')) l(slug), (VALUES (0), (1)) v(now), range(1, {NORMS + 1}) t(i) WHERE now = 1 OR i % 7 <> 0
"""


def clean_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(T.cleaned(F.replace("text", F.lit("sch"), F.lit("s-\nch")))).alias("cleaned"))


def clean_bare_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(T.without_bare_numbers(F.replace("text", F.lit("\n"), F.lit("\n 12 \n")))).alias("cleaned"))


def clean_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a header and a footer that repeat with their numbers: both go, the line between stays."""
    _views(spark, sf_dir, "lineitem")
    pages = spark.sql(f"SELECT doc_id, page, 'Seite ' || {S('page')} || '\\n{FILL}' || {S('min(n)')} || '\\nVerlag, Band ' || {S('page')} AS body FROM ({BASE}) GROUP BY doc_id, page")
    junk = cleaning.repeated_edges(pages)
    stripped = cleaning.without_edges(F.split("body", "\n", -1), F.col("junk"))
    return pages.join(junk, "doc_id", "left").select("doc_id", "page", F.md5(F.when(F.col("junk").isNotNull(), stripped).otherwise(F.col("body"))).alias("cleaned"))


_EDGES = f"""
WITH p AS (SELECT doc_id, page, min(n) AS n FROM ({BASE}) GROUP BY doc_id, page), s AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY doc_id)
SELECT doc_id, page, md5(CASE WHEN pages >= 4 THEN '{FILL}' || n ELSE 'Seite ' || page || chr(10) || '{FILL}' || n || chr(10) || 'Verlag, Band ' || page END) AS cleaned FROM p JOIN s USING (doc_id)
"""


def scanned_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of whole texts, some with empty pages enough to count as scans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    blank = docs.select(F.col("doc_id").alias("page"), (F.col("doc_id") % 500).alias("doc_id"), F.explode(F.array_repeat(F.lit(" \n"), F.when(F.col("doc_id") % 2 == 0, 200).otherwise(1))).alias("raw"))
    return cleaning.scanned(docs.select((F.col("doc_id") % 500).alias("doc_id"), F.col("doc_id").alias("page"), F.col("text").alias("raw")).unionByName(blank))


_SCANNED = r"SELECT doc_id % 500 AS doc_id, sum(length(trim(text, ' ' || chr(10)))) < 20 * sum(CASE WHEN doc_id % 2 = 0 THEN 201 ELSE 2 END) AS scanned FROM documents GROUP BY 1"


def ai_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ambiguous rows of a corpus of literature references, in batches of their documents."""
    c = cited(spark, sf_dir, "cite_verweis")
    open_ = report.ranked(report.view(report.group(c))).where("bucket = 'uneindeutig'")
    return ai.batched(open_, 3).select("doc_id", "row_key", "batch", "nr")


_BATCHES = f"""
WITH base AS ({BASE}), r AS (SELECT DISTINCT doc_id, n FROM base), k AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k FROM r)
SELECT doc_id, '[Verweis] § ' || n AS row_key, CAST(k // 3 AS INT) AS batch, CAST(k % 3 + 1 AS INT) AS nr FROM k
"""

def cite_implicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed forms with a code for citations without one, and without citations of margin numbers."""
    found = citations.extract(cleaning.clean_documents(corpus(spark, sf_dir, "cite_mixed")), _known(spark), implicit_code="BGB", drop_rn=True)
    return found.groupBy("doc_id", "page", "canonical", "law_key", "implicit").agg(F.count(F.lit(1)).alias("n"))


def _implicit_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, page, part, {c} AS canonical, {k} AS law_key FROM base" for c, k, _ in FORMS["cite_mixed"][1])
    return f"""WITH base AS ({BASE}) SELECT doc_id, page, canonical || CASE law_key WHEN '[?]' THEN ' BGB' ELSE '' END AS canonical, CASE law_key WHEN '[?]' THEN 'bgb' ELSE law_key END AS law_key, law_key = '[?]' AS implicit, count(*) AS n
FROM ({parts}) WHERE canonical IS NOT NULL AND part % 20 NOT IN (3, 5) GROUP BY ALL"""


X = S("(n % 7 + 1)")
#: One norm in several spellings, with modifiers, and without a code.
FORMS["group_flags"] = (f"'Nach § ' || {X} || CASE k % 4 WHEN 0 THEN ' BGB a.F.' WHEN 1 THEN ' B.G.B. analog' WHEN 2 THEN ' BGB' ELSE ' Abs. 2' END || ' gilt das hier.'", [])


def group_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a row gathers: shortest code, whether all its citations lack one, modifiers, variants in order, snippets by page."""
    rows = report.group(citations.extract(cleaning.clean_documents(corpus(spark, sf_dir, "group_flags")), _known(spark), implicit_code="BGB"))
    shown = F.array_join(F.transform(F.map_entries("page_sources"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.array_join(F.sort_array(e["value"]), "/"))), "|")
    return rows.select("doc_id", "row_key", "law", "implicit_only", F.array_join(F.sort_array("modifiers"), ",").alias("modifiers"), F.array_join("variants", "|").alias("variants"), shown.alias("sources"))


_FLAGS = f"""
WITH base AS ({BASE}), c AS (SELECT doc_id, page, n % 7 + 1 AS x, k % 4 AS c FROM base),
raws AS (SELECT doc_id, x, page, string_agg(DISTINCT '§ ' || x || CASE c WHEN 0 THEN ' BGB a.F.' WHEN 1 THEN ' B.G.B. analog' WHEN 2 THEN ' BGB' ELSE ' Abs. 2' END, '/' ORDER BY '§ ' || x || CASE c WHEN 0 THEN ' BGB a.F.' WHEN 1 THEN ' B.G.B. analog' WHEN 2 THEN ' BGB' ELSE ' Abs. 2' END) AS r FROM c GROUP BY ALL),
sources AS (SELECT doc_id, x, string_agg(page || ':' || r, '|' ORDER BY page) AS sources FROM raws GROUP BY ALL),
rows AS (SELECT doc_id, x, bool_or(c = 0) AS a, bool_or(c = 1) AS b, bool_or(c = 2) AS d, bool_or(c = 3) AS e FROM c GROUP BY ALL),
listed AS (SELECT *, list_filter([CASE WHEN a THEN 'a.F.' END, CASE WHEN b THEN 'analog' END], lambda v: v IS NOT NULL) AS m,
list_filter([CASE WHEN a THEN '§ ' || x || ' a.F. BGB' END, CASE WHEN e THEN '§ ' || x || ' Abs. 2 BGB' END, CASE WHEN b THEN '§ ' || x || ' analog B.G.B' END, CASE WHEN d THEN '§ ' || x || ' BGB' END], lambda v: v IS NOT NULL) AS v FROM rows)
SELECT doc_id, 'bgb § ' || x AS row_key, CASE WHEN a OR d OR e THEN 'BGB' ELSE 'B.G.B' END AS law, NOT (a OR b OR d) AS implicit_only, array_to_string(m, ',') AS modifiers, array_to_string(v, '|') AS variants, sources FROM listed JOIN sources USING (doc_id, x)
"""


def report_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a checked report in order of severity, with their status in words."""
    rows = report.group(cited(spark, sf_dir, "cite_stale"))
    shown = report.ranked(report.view(staleness.check(rows, _known(spark), law_versions(spark), YEAR)), checked=True)
    return shown.select("doc_id", "row_key", F.col("rank").cast("bigint").alias("rank"), "status_label", F.col("severity").cast("int").alias("severity"))


_SEVERITY = f"""
WITH s AS (SELECT *, split_part(row_key, ' § ', 2)::INT AS m, upper(split_part(row_key, ' ', 1)) AS u FROM ({_STALE}) t),
v AS (SELECT *, CAST(CASE status WHEN 'PARA_CHANGED' THEN 0 WHEN 'LAW_CHANGED' THEN 1 WHEN 'POSSIBLY_STALE' THEN 2 WHEN 'UNKNOWN' THEN 3 ELSE 4 END AS INT) AS severity FROM s)
SELECT doc_id, row_key, row_number() OVER (PARTITION BY doc_id ORDER BY severity, u COLLATE de, m) AS rank,
CASE status WHEN 'PARA_CHANGED' THEN 'Norm geändert' WHEN 'LAW_CHANGED' THEN 'Gesetz geändert' WHEN 'POSSIBLY_STALE' THEN 'evtl. geändert' WHEN 'UNKNOWN' THEN 'nicht geprüft' WHEN 'PARA_UNCHANGED' THEN 'Norm unverändert' ELSE 'unverändert' END AS status_label, severity FROM v
"""

M, M1, M30 = S("(n % 50 + 1)"), S("(n % 50 + 2)"), S("(n % 50 + 31)")
#: A form for each of ten rules: repealed before and after the year, other works, European and unknown law, no law, ranges, f., ff., a wide range.
FORMS["stale_rules"] = (
    "'Nach ' || " + _case({0: f"'§ ' || {M} || ' AGBG'", 1: f"'§ ' || {M} || ' TMG'", 2: f"'§ ' || {M} || ' VOB/B'", 3: f"'Art. ' || {M} || ' DSGVO'", 4: f"'§ ' || {M} || ' XYZG'", 5: f"'§ ' || {M} || ' Abs. 2'", 6: f"'§§ ' || {M} || '–' || {M1} || ' BGB'", 7: f"'§ ' || {M} || ' f. BGB'", 8: f"'§ ' || {M} || ' ff. BGB'", 9: f"'§§ ' || {M} || '–' || {M30} || ' BGB'"}, "part % 10") + " || ' gilt das hier.'", [],
)


def stale_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.group(cited(spark, sf_dir, "stale_rules"))
    return staleness.check(rows, _known(spark), law_versions(spark), YEAR).select("doc_id", "row_key", "status", "law_last_amended")


_RULES = f"""
WITH base AS ({BASE}), r AS (SELECT DISTINCT doc_id, part % 10 AS c, n % 50 + 1 AS m FROM base),
t AS (SELECT *, m % 3 = 0 OR m % 7 = 0 AS one, m % 3 = 0 OR m % 7 = 0 OR (m + 1) % 3 = 0 OR (m + 1) % 7 = 0 AS two FROM r)
SELECT doc_id, CASE c WHEN 0 THEN 'agbg § ' WHEN 1 THEN 'tmg § ' WHEN 2 THEN 'vob/b § ' WHEN 3 THEN 'dsgvo Art. ' WHEN 4 THEN 'xyzg § ' WHEN 5 THEN '[?] § ' ELSE 'bgb § ' END || m || CASE c WHEN 6 THEN '-' || (m + 1) WHEN 8 THEN ' ff.' WHEN 9 THEN '-' || (m + 30) ELSE '' END AS row_key,
CASE WHEN c = 1 THEN 'PARA_CHANGED' WHEN c < 6 THEN 'UNKNOWN' WHEN c IN (6, 7) THEN CASE WHEN two THEN 'PARA_CHANGED' ELSE 'PARA_UNCHANGED' END WHEN c = 8 THEN CASE WHEN one THEN 'PARA_CHANGED' ELSE 'LAW_CHANGED' END ELSE 'LAW_CHANGED' END AS status,
CASE WHEN c >= 6 THEN '2020-05-03' END AS law_last_amended FROM t
"""

Y = S("(n % 8 + 1)")
FORMS["ai_merge"] = (f"'Nach § ' || {Y} || CASE page % 2 WHEN 1 THEN ' BGB' ELSE ' Abs. 2' END || ' gilt das hier.'", [])


def ai_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a law, in batches, answered by rule as JSON, and the answers merged in: literature, a row that is there, a new row, unsure."""
    rows = report.group(cited(spark, sf_dir, "ai_merge"))
    open_ = ai.batched(report.ranked(report.view(rows).where("bucket = 'uneindeutig'")), 3)
    of = F.col("num_int") % 4
    answer = F.struct("nr", F.when(of == 0, "verweis").when(of == 3, "unsicher").otherwise("norm").alias("typ"), F.when(of == 1, "BGB").when(of == 2, "HGB").alias("gesetz"), F.when(of == 0, "Werk").alias("werk"))
    # An answer for no row, and one of no kind, are passed over.
    odd = F.array(F.struct(F.lit(99).alias("nr"), F.lit("norm").alias("typ"), F.lit("ZPO").alias("gesetz"), F.lit(None).cast("string").alias("werk")), F.struct(F.lit(1).alias("nr"), F.lit("x").alias("typ"), F.lit("ZPO").alias("gesetz"), F.lit(None).cast("string").alias("werk")))
    each = open_.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(F.struct("nr", "row_key", answer.alias("a")))).alias("c"))
    raw = each.select("doc_id", "batch", F.transform("c", lambda x: x["row_key"]).alias("keys"), F.to_json(F.struct(F.concat(F.transform("c", lambda x: x["a"]), odd).alias("ergebnisse"))).alias("answer"))
    merged = report.merge_verdicts(rows, ai.answers(raw))
    return merged.select("doc_id", "row_key", "law", "ai_class", "werk", _joined("pages").alias("pages"), _joined("ai_pages").alias("ai_pages"), F.array_join("variants", "|").alias("variants"))


_MERGE = f"""
WITH base AS ({BASE}), p AS (SELECT DISTINCT doc_id, n % 8 + 1 AS x, page FROM base),
b AS (SELECT doc_id, x, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM p WHERE page % 2 = 1 GROUP BY ALL),
q AS (SELECT doc_id, x, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM p WHERE page % 2 = 0 GROUP BY ALL)
SELECT doc_id, 'bgb § ' || x AS row_key, 'BGB' AS law, CAST(NULL AS VARCHAR) AS ai_class, CAST(NULL AS VARCHAR) AS werk, b.pages, CASE WHEN x % 4 = 1 THEN coalesce(q.pages, '') ELSE '' END AS ai_pages, '§ ' || x || ' BGB' || CASE WHEN x % 4 = 1 AND q.pages IS NOT NULL THEN '|§ ' || x || ' Abs. 2' ELSE '' END AS variants FROM b LEFT JOIN q USING (doc_id, x)
UNION ALL SELECT doc_id, '[?] § ' || x, '[?]', CASE x % 4 WHEN 0 THEN 'verweis' ELSE 'unsicher' END, CASE x % 4 WHEN 0 THEN 'Werk' END, pages, '', '§ ' || x || ' Abs. 2' FROM q WHERE x % 4 IN (0, 3)
UNION ALL SELECT doc_id, 'hgb § ' || x, 'HGB', 'norm', NULL, '', pages, '§ ' || x || ' Abs. 2' FROM q WHERE x % 4 = 2
UNION ALL SELECT doc_id, 'bgb § ' || x, 'BGB', 'norm', NULL, '', q.pages, '§ ' || x || ' Abs. 2' FROM q ANTI JOIN b USING (doc_id, x) WHERE x % 4 = 1
"""


def highlight_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that the snippets of a page cover, found without regard to blanks."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 1000 + 1).cast("string").alias("x"))
    strings = F.array(F.lit("Nach § "), F.col("x"), F.lit(" Abs. 2"), F.lit(""), F.lit(" BGB"), F.lit(" gilt § 0, "), F.lit("und so weiter"))
    items = part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(strings).alias("item_no", "str"))
    targets = part.select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(F.concat(F.lit("§ "), F.col("x"), F.lit(" Abs.2 BGB")), F.lit("weiter"), F.lit("x"), F.lit("fehlt"))).alias("target"))
    return highlight.hits(items, targets)


def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages put together from items: the words of documents, a line break behind each eighth."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "[ \\n]+")).alias("item_no", "w"))
    items = docs.select("doc_id", F.lit(1).alias("page"), "item_no", F.concat("w", F.lit(" ")).alias("str"), (F.col("item_no") % 8 == 7).alias("has_eol"))
    return pages.plain_pages(items).select("doc_id", "page", F.md5("raw").alias("raw"))


_ITEMS = r"""
WITH w AS (SELECT doc_id, string_split_regex(text, '[ \n]+') AS w FROM documents), e AS (SELECT doc_id, i, w[i] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w))
SELECT doc_id, CAST(1 AS INT) AS page, md5(string_agg(x || ' ' || CASE WHEN i % 8 = 0 THEN chr(10) ELSE '' END, '' ORDER BY i)) AS raw FROM e GROUP BY doc_id
"""


def audit_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.law_distribution(report.group(cited(spark, sf_dir, "cite_basic")), 3).select("law", "rows")


def audit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register from the columns against what is read: sections that are cited, that ranges cover, of another law, and of none."""
    _views(spark, sf_dir, "lineitem")
    gold = spark.sql(f"SELECT doc_id, lower(code) AS law_key, '§' AS kind, explode(array(n, n + 5, n + 5000)) AS num_int FROM ({BASE}) UNION ALL SELECT doc_id, 'xyzg', '§', n FROM ({BASE})")
    return audits.recall(gold, cited(spark, sf_dir, "cite_range_ff"))


_RECALL = f"""
WITH base AS ({BASE}), g AS (SELECT DISTINCT doc_id, code, m FROM (SELECT doc_id, code, unnest([n, n + 5]) AS m FROM base)), o AS (SELECT DISTINCT doc_id, code, n FROM base), z AS (SELECT DISTINCT doc_id, n FROM base)
SELECT 'law' AS hit, count(*) AS n FROM g UNION ALL SELECT 'miss', (SELECT count(*) FROM o) + (SELECT count(*) FROM z)
"""


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.sampled(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), ["p_partkey"], 25, 7)


def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.clean_documents(corpus(spark, sf_dir, "cite_validation"))
    return audits.warnings(clean, citations.extract(clean, _known(spark)))


_WARNINGS = f"""
WITH base AS ({BASE}), c AS (SELECT doc_id, CASE k WHEN 3 THEN 'XYZG' ELSE 'Musterordnung' END AS code, count(*) AS n FROM base WHERE k IN (3, 5) GROUP BY ALL)
SELECT doc_id, 'Unbekanntes Kürzel „' || code || '“ (' || n || '×) – wird ohne Prüfung übernommen.' AS message FROM c
"""

#: Forms whose query gives the citations themselves.
CITED = [name for name in FORMS if name.startswith("cite_") and name != "cite_stale"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: partial(cite, form=name) for name in CITED},
    "group_norms": group_norms, "implied_pages": implied_pages, "report_rank": report_rank,
    "csv_rows": partial(export_lines, lines=report.csv_lines), "md_rows": partial(export_lines, lines=report.md_lines), "html_rows": partial(export_lines, lines=report.html_lines), "csv_files": csv_files,
    "registry_resolve": registry_resolve, "group_unresolved": unresolved_codes, "snapshot_asof": snapshot_asof, "law_norms": law_norms, "stale_cascade": stale_cascade,
    "clean_hyphens": clean_hyphens, "clean_bare_numbers": clean_bare_numbers, "clean_edges": clean_edges, "scanned_docs": scanned_docs, "ai_batches": ai_batches,
    "cite_implicit": cite_implicit, "group_flags": group_flags, "report_severity": report_severity, "stale_rules": stale_rules, "ai_merge": ai_merge, "highlight_hits": highlight_hits,
    "item_pages": item_pages, "audit_laws": audit_laws, "audit_recall": audit_recall, "audit_sample": audit_sample, "run_warnings": run_warnings,
}

_SPACE = "regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')"
ORACLES: dict[str, str] = {
    **{name: _cite_sql(name) for name in CITED},
    "group_norms": _NORMS + "SELECT doc_id, row_key, code AS law, array_to_string(pages, ',') AS pages, label || ' ' || code AS variants, false AS implicit_only FROM t",
    "implied_pages": _NORMS + "SELECT doc_id, row_key, array_to_string(implied, ',') AS implied FROM t WHERE len(implied) > 0",
    "report_rank": _NORMS + "SELECT doc_id, row_key, row_number() OVER (PARTITION BY doc_id ORDER BY code COLLATE de, n, open) AS rank, bucket, label, pages_text FROM t",
    "csv_rows": _NORMS + "SELECT doc_id, row_key, CASE open WHEN 0 THEN 'geprüft' ELSE 'selbst prüfen' END || ';' || code || ';' || label || ';' || label || ' ' || code || ';' || pages_text || ';;' AS line FROM t",
    "md_rows": _NORMS + "SELECT doc_id, row_key, '| ' || code || ' | ' || label || ' | ' || label || ' ' || code || ' | ' || pages_text || ' |  |  |' AS line FROM t",
    "html_rows": _NORMS + "SELECT doc_id, row_key, '<tr>' || chr(10) || '  <td>' || code || '</td>' || chr(10) || '  <td>' || label || '</td>' || chr(10) || '  <td>' || label || ' ' || code || '</td>' || chr(10) || '  <td>' || pages_text || '</td>' || chr(10) || '  <td></td>' || chr(10) || '  <td></td>' || chr(10) || '</tr>' AS line FROM t",
    "csv_files": _NORMS + f"""SELECT doc_id, md5('﻿{report.CSV_HEADER}' || chr(13) || chr(10) || string_agg(CASE open WHEN 0 THEN 'geprüft' ELSE 'selbst prüfen' END || ';' || code || ';' || label || ';' || label || ' ' || code || ';' || pages_text || ';;', chr(13) || chr(10) ORDER BY open, code COLLATE de, n)) AS file FROM t GROUP BY doc_id""",
    "registry_resolve": _registry_sql(),
    "group_unresolved": f"WITH base AS ({BASE}) SELECT CASE k WHEN 3 THEN 'XYZG' ELSE 'Musterordnung' END AS code, count(*) AS n, count(DISTINCT doc_id) AS documents FROM base WHERE k IN (3, 5) GROUP BY 1",
    "snapshot_asof": "SELECT CAST(o_custkey AS VARCHAR) AS slug, CAST(max_by(o_orderkey, o_orderdate + to_microseconds(o_orderkey)) AS VARCHAR) AS sha FROM orders WHERE o_orderdate + to_microseconds(o_orderkey) < TIMESTAMP '1996-07-01' GROUP BY 1",
    "law_norms": _LAW_NORMS, "stale_cascade": _STALE,
    "clean_hyphens": f"SELECT doc_id, md5(trim({_SPACE.format('text')})) AS cleaned FROM documents",
    "clean_bare_numbers": "SELECT doc_id, md5(text) AS cleaned FROM documents",
    "clean_edges": _EDGES, "scanned_docs": _SCANNED, "ai_batches": _BATCHES,
    "cite_implicit": _implicit_sql(), "group_flags": _FLAGS, "report_severity": _SEVERITY, "stale_rules": _RULES, "ai_merge": _MERGE,
    "highlight_hits": "SELECT p_partkey AS doc_id, CAST(1 AS INT) AS page, CAST(unnest([0, 1, 2, 4, 6]) AS INT) AS item_no FROM part",
    "item_pages": _ITEMS, "audit_recall": _RECALL, "run_warnings": _WARNINGS,
    "audit_laws": f"WITH base AS ({BASE}) SELECT code AS law, count(DISTINCT (doc_id, n)) AS rows FROM base GROUP BY code ORDER BY rows DESC, law LIMIT 3",
    "audit_sample": "SELECT p_partkey FROM part ORDER BY md5('7/' || p_partkey), p_partkey LIMIT 25",
}
