"""Has a cited norm changed since a document's year? Rows of the report against versions of the law.

Defined results: rows without a doc_id are judged by their law alone, as their norms meet no texts; a law without versions, or with a null
text, isn't loadable; of several versions at one time any counts; empty tables give empty results. What is said of a row depends on its norm
alone, so each norm is judged once, however many documents cite it; the norms are written once while the plan is built, as three joins begin
with them, and so are rows that materialize() has not made.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.functions import text as T
from normlake.operators import registry
from normlake.operators.report import RANGE_LIMIT
from normlake.session import materialize
from normlake.sources import laws

#: The columns of a row on which its judgement depends, beside whether it belongs to a document.
NORM = ("law", "ai_class", "kind", "number", "number_end", "ff")


def states(rows: DataFrame, versions: DataFrame, year: int) -> DataFrame:
    """slug, amended, now_state, now_sha, then_sha: one row for each cited law. Snapshots are looked up only for laws amended after the year."""
    cited = rows.where("slug IS NOT NULL").select("slug").distinct()
    now = laws.current(versions).join(cited, "slug", "left_semi").select("slug", F.col("sha").alias("now_sha"), F.col("fetch_state").alias("now_state"), laws.last_amended(F.col("xml")).alias("amended"), F.col("xml").isNotNull().alias("loaded"))
    then = laws.snapshot(versions.join(cited, "slug", "left_semi"), F.lit(f"{year}-12-31")).withColumnRenamed("sha", "then_sha")
    state = versions.select("slug", F.col("sha").alias("then_sha"), F.col("fetch_state").alias("then_state"), F.col("xml").isNotNull().alias("then_loaded"))
    late = now.join(then, "slug", "left").join(state, ["slug", "then_sha"], "left")
    return late.withColumn("then_sha", F.when((F.col("amended") > f"{year}-12-31") & F.coalesce("then_loaded", F.lit(False)), F.col("then_sha"))).drop("then_loaded")


def numbers(number: Column, number_end: Column, ff: Column) -> Column:
    """Norms to compare: a narrow range's, a norm and the next one, or the norm; a range that runs backwards has none."""
    n, width = T.number_prefix(number), T.span_width(number, number_end)
    ranged = F.when(width > 0, F.transform(F.sequence(n, F.greatest(n, n + width - 1)), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.when(number_end.isNotNull(), ranged).when(ff == "f.", F.array(number, (n + 1).cast("string"))).otherwise(F.array(number))


def compared(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """norm_id, n, changed, unknown: the norms of a row, those that differ between its then_sha and now_sha, and those found in neither."""
    due = rows.where("placed AND then_sha IS NOT NULL").where(T.span_width(F.col("number"), F.col("number_end")) <= RANGE_LIMIT)
    each = due.select("norm_id", "slug", "kind", "then_sha", "now_sha", F.posexplode(numbers(F.col("number"), F.col("number_end"), F.col("ff"))).alias("k", "number"))
    needed = due.select("slug", F.explode(F.array("then_sha", "now_sha")).alias("sha")).distinct()
    texts = laws.norms(versions.join(needed, ["slug", "sha"], "left_semi"))
    side = lambda s: texts.select("slug", F.col("sha").alias(f"{s}_sha"), "kind", "number", F.when(F.col("text") != "", F.col("text")).alias(f"{s}_text"))
    both = each.join(side("then"), ["slug", "then_sha", "kind", "number"], "left").join(side("now"), ["slug", "now_sha", "kind", "number"], "left")
    lost = F.col("then_text").isNull() & F.col("now_text").isNull()
    differs = ~lost & ~F.col("then_text").eqNullSafe(F.col("now_text"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("k", "number")))), lambda x: x["number"])
    return both.groupBy("norm_id").agg(F.count(F.lit(1)).alias("n"), listed(differs).alias("changed"), listed(lost).alias("unknown"))


def check(rows: DataFrame, known: DataFrame, versions: DataFrame, year: int) -> DataFrame:
    """rows with status, law_last_amended, note: the first rule that holds decides.

    A source that refuses (fetch_state rate_limited) is a matter of each law here, not of all that come after it. Rows are read twice, for
    their distinct norms and for the join with what is said of these, which is broadcast after a count as the dictionary is.
    """
    rows = rows if hasattr(rows, "_normlake_path") else materialize(rows)
    placed = (F.col("doc_id").isNotNull() & F.col("row_key").isNotNull()).alias("placed")
    norms = registry.sized(materialize(judged(rows.select(*NORM, placed).distinct(), known, versions, year)))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"j.{c}")) for c in (*NORM, "placed")]
    met = rows.select("*", placed).alias("r").join(norms.alias("j"), reduce(and_, same), "left")
    return met.select(*(f"r.{c}" for c in rows.columns), "j.status", "j.law_last_amended", "j.note")


def judged(norms: DataFrame, known: DataFrame, versions: DataFrame, year: int) -> DataFrame:
    """Distinct norms (NORM, placed) with status, law_last_amended, note."""
    cols = norms.columns
    # Ids are fixed by writing them.
    resolved = materialize(registry.resolve(norms, known, "law").withColumn("norm_id", F.monotonically_increasing_id()))
    whole = resolved.join(materialize(states(resolved, versions, year)), "slug", "left")
    found = whole.join(compared(whole, versions), "norm_id", "left")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    law, amended, start, end = F.col("law"), F.col("amended"), f"{year}-01-01", f"{year}-12-31"
    label, width = T.norm_label(F.col("kind"), F.col("number"), F.col("number_end"), F.col("ff")), T.span_width(F.col("number"), F.col("number_end"))
    open_, limited = F.coalesce(F.col("ff") == "ff.", F.lit(False)), F.coalesce(F.col("now_state") == "rate_limited", F.lit(False))
    then_limited = F.coalesce(F.col("then_state") == "rate_limited", F.lit(False))
    law_note = say(law, " zuletzt geändert ", T.german_date(amended), ".")
    names = lambda c: F.array_join(F.transform(c, lambda n: F.concat(F.col("kind"), F.lit(" "), n)), ", ")
    caveat = F.when(open_, " Umfang des ff.-Zitats unbestimmt – Folgenormen bitte selbst prüfen.").otherwise("")
    which = F.when(F.col("n") > 1, say(" (geändert: ", names(F.col("changed")), ")")).otherwise("")
    missing = F.when(F.size("unknown") > 0, say(" (", names(F.col("unknown")), " nicht auffindbar.)")).otherwise("")
    gone = F.when(F.length("repealed") >= 10, T.german_date(F.col("repealed"))).otherwise(F.col("repealed"))
    none, date = F.lit(None).cast("string"), amended
    rules = [
        (F.col("ai_class") == "verweis", "UNKNOWN", none, F.lit("KI-klassifiziert: Literaturverweis, keine Norm.")),
        (F.col("ai_class") == "unsicher", "UNKNOWN", none, F.lit("KI unsicher – bitte selbst prüfen.")),
        (law == "[Verweis]", "UNKNOWN", none, F.lit("Verweis auf Literatur oder Kapitel – keine Norm.")),
        (law == "[?]", "UNKNOWN", none, F.lit("Kein Gesetzeskürzel erkannt.")),
        (F.col("display").isNull(), "UNKNOWN", none, say("Unbekanntes Kürzel „", law, "“.")),
        (F.substring("repealed", 1, 4).cast("int") > year, "PARA_CHANGED", none, say(F.col("display"), " wurde zum ", gone, " aufgehoben – heute: ", F.col("successor"), ".")),
        (F.col("repealed").isNotNull(), "UNKNOWN", none, say(F.col("display"), " war bereits seit ", gone, " außer Kraft (heute: ", F.col("successor"), ").")),
        (F.col("work_kind").isNotNull(), "UNKNOWN", none, say("Kein Bundesgesetz – ", F.col("work_kind"), " (keine Änderungsprüfung möglich).")),
        (F.col("is_eu") | F.col("slug").isNull(), "UNKNOWN", none, F.lit("EU-/internationales Recht wird noch nicht geprüft.")),
        (~F.coalesce("loaded", F.lit(False)) & limited, "UNKNOWN", none, F.lit("Prüfung nicht möglich (Abruflimit der Quelle erreicht – später erneut versuchen).")),
        (~F.coalesce("loaded", F.lit(False)), "UNKNOWN", none, F.lit("Gesetzestext konnte nicht geladen werden.")),
        (amended.isNull(), "UNCHANGED", none, say("Keine Änderungsdaten für ", law, " gefunden.")),
        (amended < start, "UNCHANGED", date, say(law, " seit ", T.german_date(amended), " unverändert.")),
        (amended <= end, "POSSIBLY_STALE", date, say(law, " wurde noch ", T.german_date(amended), " geändert – im Erscheinungsjahr selbst.")),
        (width > RANGE_LIMIT, "LAW_CHANGED", date, say(law_note, " Bereichszitat über ca. ", width.cast("string"), " Normen – Einzelprüfung deaktiviert, bitte relevante Normen selbst prüfen.")),
        (F.size("changed") > 0, "PARA_CHANGED", date, say(label, " ", law, f" wurde seit {year} geändert!", which, caveat)),
        ((F.col("n") > F.size("unknown")) & open_, "LAW_CHANGED", date, say(law_note, " Startnorm ", F.col("kind"), " ", F.col("number"), f" ist textgleich zum Stand {year}.", caveat)),
        (F.col("n") > F.size("unknown"), "PARA_UNCHANGED", date, say(law_note, " ", label, f" selbst ist textgleich zum Stand {year}.", missing)),
        (F.col("then_sha").isNotNull(), "LAW_CHANGED", date, say(law_note, " (", F.col("kind"), " ", F.col("number"), " dort nicht auffindbar – nur Gesetzesebene geprüft.)")),
        (then_limited, "LAW_CHANGED", date, say(law_note, " (Abruflimit erreicht – Norm-Vergleich später erneut versuchen.)")),
        (F.lit(True), "LAW_CHANGED", date, law_note),
    ]
    made = F.lit(None)
    for cond, status, when, note in reversed(rules):
        made = F.when(cond, F.struct(F.lit(status).alias("status"), when.alias("law_last_amended"), note.alias("note"))).otherwise(made)
    # What the classifier said of a norm stays with it.
    told = F.when(F.col("ai_class") == "norm", F.concat(F.col("_s.note"), F.lit(" (Gesetz KI-zugeordnet – bitte prüfen.)"))).otherwise(F.col("_s.note"))
    return found.withColumn("_s", made).select(*cols, F.col("_s.status").alias("status"), F.col("_s.law_last_amended").alias("law_last_amended"), told.alias("note"))
