"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Spans come from leftmost non-overlapping matches: pieces between matches (split) and the matches themselves add up to offsets in code
points. Every candidate's value is hashed; a hash is counted once for each owner and once for each repository (distinct ones, then a count: no
group is gathered). Values that `copied_from` or more owners, or as many repositories, share are widely copied examples; the others are
owner-specific and live-looking. Owner and repository are columns; without one for repositories, owners alone count.

Kinds beyond the contract's: jwt (three-part web tokens), pem (private-key headers), vendor (prefixed vendor tokens).

Defined results: null text is empty text, which has no spans; a null owner is one owner, as is a null repository; rows that repeat doc_id and text are scanned
each and their candidates counted once; rows with a null doc_id are scanned, and judged by their text; a document of any length is one
row. Extra columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.llm import common

#: Fixed values of the contract.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: The method's own kinds, with a string that every match has.
MORE = {
    "jwt": ("eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "eyJ"),
    "pem": ("-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "-----BEGIN "),
    "vendor": ("(?:ghp|gho|ghs|xoxb|xoxp|sk_live)[_-][A-Za-z0-9-]{20,}", "_"),
}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, *MORE)
#: Distinct owners from which on a value counts as a copied example.
COPIED_FROM = 3
MASK = "[SECRET]"
#: A span and the hash of its value.
SPAN = "array<struct<begin:int,kind:int,end:int,value:bigint>>"
_SALTS = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, although body's lambdas use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int, group: int, least: int, hint: Column) -> Column:
    """array<struct<begin, kind, end, value>> of the matches whose group has `least` characters or more.

    Offsets are running sums of lengths. They are taken in chunks of about the root of the number of matches, because a fold copies
    its array at each step: n matches cost n ** 1.5 steps, not n ** 2.
    """
    none = F.lit(None).cast(SPAN)
    empty = F.filter(F.array(F.struct(F.lit(0).alias("begin"), F.lit(0).alias("kind"), F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("value"))), lambda x: F.lit(False)).cast(SPAN)
    span = lambda begin, end, value: F.struct(begin.cast("int").alias("begin"), F.lit(kind).alias("kind"), end.cast("int").alias("end"), value.alias("value"))

    def chunk(found: Column, first: Column, last: Column) -> Column:
        """struct<at, out>: length of the matches first to last with the gaps before them; their spans, counted from there."""

        def step(acc: Column, k: Column) -> Column:
            begin, match = acc["at"] + F.length(F.element_at(found["between"], k)), F.element_at(found["whole"], k)
            end, value = begin + F.length(match), F.regexp_extract(match, pattern, group) if group else match
            out = F.when(F.length(value) >= least, F.array_append(acc["out"], span(begin, end, F.xxhash64(value)))).otherwise(acc["out"])
            return F.struct(end.cast("int").alias("at"), out.alias("out"))

        return F.aggregate(F.sequence(first, last), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def chunks(found: Column) -> Column:
        n = F.size(found["whole"])
        size = F.ceil(F.sqrt(n)).cast("int")
        return F.transform(F.sequence(F.lit(1), n, size), lambda k: chunk(found, k, F.least(n, k + size - 1)))

    def placed(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(parts, zero, lambda acc, c: F.struct((acc["at"] + c["at"]).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, starts, lambda c, at: F.transform(c["out"], lambda s: span(at + s["begin"], at + s["end"], s["value"]))))

    matches = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("between"))
    found = _let(matches, lambda m: _let(chunks(m), placed)).cast(SPAN)
    return F.coalesce(F.when(hint & text.rlike(pattern), found).otherwise(none), empty)


def spans(text: Column) -> Column:
    """All spans of a text, by start, then kind."""
    t = F.coalesce(text, F.lit(""))
    found = [
        _spans(t, ASSIGN, 0, 2, ASSIGN_LEAST, F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))),
        _spans(t, ACCESS, 1, 0, 20, F.contains(t, F.lit("AKIA"))),
        _spans(t, HEX, 2, 0, 24, F.lit(True)),
        *(_spans(t, p, 3 + k, 0, 1, F.contains(t, F.lit(hint))) for k, (p, hint) in enumerate(MORE.values())),
    ]
    return F.array_sort(F.concat(*found))


def _shown(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["end"].cast("string"))), ",")


def _named(owner: str, repository: str | None) -> list[Column]:
    return [F.col(owner).alias("owner"), *([F.col(repository).alias("repository")] if repository else [])]


def judged(spark: SparkSession, found: DataFrame, copied_from: int = COPIED_FROM) -> DataFrame:
    """found: doc_id, text_hash, owner (and repository), spans. A row for each (doc_id, text_hash) with spans, as _doc and _hash: `live` (spans of owner-specific values, in order) and n_copied."""
    names = [c for c in ("owner", "repository") if c in found.columns]
    each = found.select("doc_id", "text_hash", *names, F.explode("spans").alias("span")).withColumn("value", F.col("span.value")).distinct()
    # Owners and repositories go through one exchange, told apart by a number.
    who = F.array(*(F.struct(F.lit(k).alias("as"), F.col(c).cast("string").alias("name")) for k, c in enumerate(names)))
    by = each.select("value", F.explode(who).alias("who")).distinct().groupBy("value")
    owners = by.agg(F.greatest(*(F.count(F.when(F.col("who.as") == k, 1)) for k in range(2))).alias("n_owners"))
    # A value that a third of all documents share is met by several tasks.
    owners = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(_SALTS)).cast("int"))
    copied = F.col("n_owners") >= copied_from
    return salted.join(owners, ["value", "salt"]).groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.array_distinct(F.collect_list(F.when(~copied, F.col("span"))))).alias("live"), F.count_distinct(F.when(copied, F.col("span"))).alias("n_copied"))


def scan(spark: SparkSession, docs: DataFrame, owner: str = "source", copied_from: int = COPIED_FROM, repository: str | None = None) -> DataFrame:
    """doc_id, spans (array), live (array of the owner-specific ones), n_copied: a row for each row of docs."""
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *_named(owner, repository), spans(F.col("text")).alias("spans"))
    found = common.materialize(spark, found)
    some = found.where(F.size("spans") > 0)
    by = judged(spark, some, copied_from)
    none = F.array().cast(SPAN)
    rows = some.join(by, F.expr("doc_id <=> _doc AND text_hash = _hash"), "left").select("doc_id", "spans", F.coalesce("live", none).alias("live"), F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"))
    return rows.unionAll(found.where(F.size("spans") == 0).select("doc_id", "spans", none, F.lit(0).cast("bigint")))


def masked(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with each of the sorted spans (overlapping ones as one) replaced."""
    step = lambda acc, s: F.when(s["begin"] >= acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["begin"] - acc["at"]), F.lit(mask)).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(spark: SparkSession, docs: DataFrame, owner: str = "source", copied_from: int = COPIED_FROM, repository: str | None = None) -> DataFrame:
    """docs, all columns, with live-looking secrets in `text` masked and `n_chars`, if there, set anew. Only documents that have spans move."""
    names, docs = docs.columns, common.numbered(docs, "doc_id", "text", "n_chars", owner, *([repository] if repository else []))
    named = docs.withColumn("text_hash", F.xxhash64("text")).withColumn("_spans", spans(F.col("text")))
    some = named.where(F.size("_spans") > 0)
    found = common.materialize(spark, some.select("doc_id", "text_hash", *_named(owner, repository), F.col("_spans").alias("spans")))
    by = judged(spark, found, copied_from).where(F.size("live") > 0)
    hit = some.join(by, F.expr("doc_id <=> _doc AND text_hash = _hash"), "left")
    hit = hit.withColumn("_new", F.when(F.col("live").isNotNull(), masked(F.col("text"), F.col("live"))).otherwise(F.col("text")))
    cols = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.col("_new")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("live").isNotNull(), F.length("_new")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return hit.select(*(c.alias(n) for n, c in cols.items())).unionByName(named.where(F.size("_spans") == 0).select(*docs.columns)).toDF(*names)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark, common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"), F.size("live").cast("bigint").alias("n_live"), "n_copied")


def _oracle() -> str:
    kinds = [("assign", ASSIGN, 2, ASSIGN_LEAST), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), *((k, p, 0, 1) for k, (p, _) in MORE.items())]
    parts = []
    for k, (_, pattern, group, least) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, source, {k} AS kind, b AS begin_, b + length(m) AS end_, v AS value FROM (SELECT doc_id, source, m, v, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b FROM "
            f"(SELECT doc_id, source, i, ms, s, ms[i] AS m, {'regexp_extract(ms[i], ' + repr_sql(p) + f', {group})' if group else 'ms[i]'} AS v FROM (SELECT doc_id, source, ms, string_split_regex(t, {repr_sql(p)}) AS s, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {repr_sql(p)}) AS ms FROM documents)))) WHERE length(v) >= {least}"
        )
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH sp AS ({' UNION ALL '.join(parts)}),
own AS (SELECT value, count(DISTINCT coalesce('=' || source, '')) AS n FROM sp GROUP BY value),
j AS (SELECT doc_id, kind, begin_, end_, {names}[kind + 1] || ':' || CAST(begin_ AS BIGINT) || ':' || CAST(end_ AS BIGINT) AS shown, n FROM sp JOIN own USING (value)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c, count(*) FILTER (kind = 2) AS h, string_agg(shown, ',' ORDER BY begin_, kind) FILTER (kind < 3) AS base, string_agg(shown, ',' ORDER BY begin_, kind) AS spans, count(*) FILTER (n < {COPIED_FROM}) AS live, count(*) FILTER (n >= {COPIED_FROM}) AS copied FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(copied, 0) AS n_copied FROM documents d LEFT JOIN g USING (doc_id)
"""


def repr_sql(p: str) -> str:
    return f"'{p}'"


ORACLE = _oracle()
