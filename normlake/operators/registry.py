"""Law codes: a dictionary frame with a row for each key, and the resolution of codes in a fixed order.

Defined results: a null code has no verdict, an empty one is unknown; of slugs that share a key the one with the greatest ordinal counts, of
slugs with a year the greatest; an empty list of slugs leaves the fixed tables; other columns of the codes are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.functions import dictionaries as D
from normlake.functions import text as T

#: Rows up to which the dictionary is broadcast; beyond, joins are left to the planner. The fixed tables have some 300 keys, a list of all federal laws some 20 000.
BROADCAST_ROWS = 100_000
_FIELDS = ("rejected boolean", "aliased boolean", "alias_slug string", "work string", "work_kind string", "eu string", "direct string", "prefixed string", "old string", "old_name string", "repealed string", "successor string")


def fallback_slugs(spark: SparkSession) -> DataFrame:
    """ordinal, slug: common codes in lower case."""
    return spark.createDataFrame([(k, r[0].lower()) for k, r in enumerate(D.rows(D.FALLBACK))], "ordinal int, slug string")


def _key(code: str) -> str:
    return "".join(c for c in code.lower() if not c.isspace() and c not in ".-–")


def dictionary(spark: SparkSession, slugs: DataFrame | None = None) -> DataFrame:
    """One row for each key, with what each table says of it. slugs: ordinal, slug; of several laws that share a key the last one has it."""
    names = [f.split()[0] for f in _FIELDS]
    fixed: dict[str, dict] = {}
    put = lambda key, **v: fixed.setdefault(key, {}).update(v)
    for (code,) in D.rows(D.REJECTED):
        put(_key(code), rejected=True)
    for code, slug in D.rows(D.SLUG_ALIASES):
        put(_key(code), aliased=True, alias_slug=slug or None)
    for code, kind in D.rows(D.WORKS):
        put(_key(code), work=code, work_kind=kind)
    for code, _, *aliases in D.rows(D.EU_LAWS):
        for x in [code, *aliases]:
            put(_key(x), eu=code)
    for code, name, date, successor in D.rows(D.REPEALED):
        put(_key(code), old=code, old_name=name, repealed=date, successor=successor)
    tables = spark.createDataFrame([(k, *(v.get(n) for n in names)) for k, v in fixed.items()], f"key string, {', '.join(_FIELDS)}")
    slugs = fallback_slugs(spark) if slugs is None else slugs
    base = F.regexp_replace("slug", "_[0-9]{1,4}$", "")
    joined = lambda c: T.code_key(F.replace(c, F.lit("_"), F.lit("")))
    keys = F.array_distinct(F.array_compact(F.array(joined(F.col("slug")), joined(base), F.when(F.contains(base, F.lit("_")), base))))
    direct = slugs.select("ordinal", "slug", F.explode(keys).alias("key")).groupBy("key").agg(F.max_by("slug", "ordinal").alias("direct"))
    parts = F.split("slug", "_", -1)
    probes = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_")))
    prefixed = slugs.select("slug", F.explode(probes).alias("key")).groupBy("key").agg(F.max("slug").alias("prefixed"))
    whole = tables.unionByName(direct, allowMissingColumns=True).unionByName(prefixed, allowMissingColumns=True)
    return whole.groupBy("key").agg(*(F.max(n).alias(n) for n in names))


def resolve(codes: DataFrame, known: DataFrame, code: str, prefix: str = "") -> DataFrame:
    """codes with verdict (reject, known, unknown), slug, is_eu, work_kind, display, repealed, successor, each name after `prefix`.

    Rows with a null code have no verdict. How the dictionary is joined is a matter of the frame `known`: sized() marks a small one.

    Order: reject list, alias (an empty one ends the search), other works, European law, the pattern of numbered European acts, slug,
    slug with _ for umlauts, slug with a year behind the key, repealed laws, ending in VO or RL.
    """
    plain, umlaut = known.select(F.struct(*known.columns).alias("_k")), known.select(F.struct("key", "direct", "prefixed").alias("_u"))
    key, c = T.code_key(F.col(code)), F.col(code)
    keyed = codes.withColumn("_key", key).withColumn("_ukey", F.regexp_replace("_key", "[äöü]", "_"))
    met = keyed.join(plain, F.col("_key") == F.col("_k.key"), "left").join(umlaut, F.col("_ukey") == F.col("_u.key"), "left")
    numbered = F.col("_key").rlike("^(vo|verordnung|rl|richtlinie)\\(?(eu|eg|ewg)\\)?(nr)?[0-9]+/[0-9]+$")
    ending = F.col("_key").rlike("(?:vo|rl)$") & (F.length("_key") > 3)
    k = lambda n: F.col(f"_k.{n}")
    none = F.coalesce(F.col("_key") == "", F.lit(True)) | F.coalesce(k("rejected"), F.lit(False))
    slug = F.coalesce(k("direct"), F.col("_u.direct"), k("prefixed"), F.col("_u.prefixed"))
    fields = ("display", "slug", "is_eu", "work_kind", "repealed", "successor")

    def made(display: Column, **v: Column) -> Column:
        empty = {"slug": F.lit(None).cast("string"), "is_eu": F.lit(False), "work_kind": F.lit(None).cast("string"), "repealed": F.lit(None).cast("string"), "successor": F.lit(None).cast("string")}
        return F.struct(*(({"display": display} | empty | v)[f].alias(f) for f in fields))

    found = (
        F.when(none, F.lit(None))
        .when(k("aliased"), F.when(k("alias_slug").isNotNull(), made(c, slug=k("alias_slug"))))
        .when(k("work").isNotNull(), made(k("work"), work_kind=k("work_kind")))
        .when(k("eu").isNotNull(), made(k("eu"), is_eu=F.lit(True)))
        .when(numbered, made(c, is_eu=F.lit(True)))
        .when(slug.isNotNull(), made(c, slug=slug))
        .when(k("old").isNotNull(), made(k("old"), repealed=k("repealed"), successor=k("successor")))
        .when(ending, made(c, is_eu=F.lit(True)))
    )
    rejected = F.coalesce(k("rejected"), F.lit(False))
    verdict = F.when(c.isNotNull(), F.when(rejected, "reject").when(found.isNotNull(), "known").otherwise("unknown"))
    return met.withColumn("_f", found).withColumns({f"{prefix}verdict": verdict} | {f"{prefix}{f}": F.col(f"_f.{f}") for f in fields}).drop("_key", "_ukey", "_k", "_u", "_f")


def sized(known: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The dictionary, counted: marked for broadcast with at most `most` rows. The mark travels with this frame and with no other."""
    return F.broadcast(known) if known.count() <= most else known
