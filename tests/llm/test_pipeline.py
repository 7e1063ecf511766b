"""The pipeline: every stage against a brute-force version of what it has to do, written here anew, on driver tables of the smallest size if
they are there; and on odd and empty tables."""

import math
import os
import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    top, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        got.write.parquet(str(top / name))
        out.append((name, docs, spark.read.parquet(str(top / name))))
        docs = out[-1][2]
    return {name: (a, b) for name, a, b in out}


def words(text):
    """Words of letters, digits and characters beyond ASCII, A-Z lowered."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_columns(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, (_, out) in list(steps.items())[:-1]:
        assert out.columns == docs.columns, name


def test_quality(spark, steps):
    """P(grade above the lowest) from the fitted weights, by the definition of the features, a token after the other."""
    from normlake.llm import op8_quality as q

    before, after = steps["quality"]
    model = q.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    bucket = lambda kind, value: zlib.crc32(f"{kind}{value}".encode()) % (1 << q.BITS)

    def kept(text):
        tokens, count = (text or "").split(), {}
        for k, t in enumerate(tokens):
            each = [bucket("s", q.shape(t)), bucket("w", t)]
            if k:
                a, b = (zlib.crc32(q.shape(x).encode()) for x in (tokens[k - 1], t))
                each += [(b * 31 + a * 17 + 5) % (1 << q.BITS)] + [bucket("r", "")] * (3 * (tokens[k - 1] == t))
            for b in each:
                count[b] = count.get(b, 0) + 1
        score = sum(model.weights[b] * math.sqrt(n / len(tokens)) for b, n in count.items())
        return 1 / (1 + math.exp(min(50, max(-50, model.thresholds[0] - score)))) >= 0.5

    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if kept(r.text))


def test_near_duplicates(steps):
    """Components of all pairs of texts whose five-word shingles are alike to 0.8 or more. What goes is a copy of what stays; hardly a copy stays."""
    before, after = steps["near_duplicates"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else {(t or "").strip()} for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    left = {r.doc_id for r in after.collect()}
    gone = [k for k, (doc_id, _) in enumerate(rows) if doc_id not in left]
    copies = [k for k in range(len(rows)) if top(k) != k]
    assert set(gone) <= set(copies)
    assert len(gone) >= 0.97 * len(copies)
    assert all(any(top(j) == top(k) and rows[j][0] in left for j in range(k)) for k in gone)


def test_decontaminate(spark, steps):
    before, after = steps["decontaminate"]
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, set()).add(tuple(w[i : i + n]))

    def dirty(t):
        w = words(t)
        return any(tuple(w[i : i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if not dirty(r.text))


#: Kind, pattern, group that is measured, its least length.
SECRETS = [
    (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]{16,}", 0, 20), (r"[0-9a-f]{24,}", 0, 24),
    (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1), (r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 1), (r"(?:ghp|gho|ghs|xoxb|xoxp|sk_live)[_-][A-Za-z0-9-]{20,}", 0, 1),
]


def test_secrets(spark, steps):
    """Spans by the patterns, owners by hand, and the text cut and put together again."""
    planted = [(9000 + k, f"{'é' * k}login password: \"live{k % 4}secret{k}\" and AKIA{'ABCDEFGHIJKLMNOP' if k % 2 else 'QRSTUVWXYZ234567'} {k:024x} api_key=example123, token = ab{k}", "en", f"o{k % 3}", 7) for k in range(12)]
    planted += [(9100, "secret: token: abcdefgh eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9 + " -----BEGIN RSA PRIVATE KEY----- ghp_" + "x" * 22, "en", None, 7)]
    before = steps["secrets"][0].unionAll(spark.createDataFrame(planted, COLUMNS))
    after = corpus_pipeline.secrets(spark, before, SF)
    found, owners = {}, {}
    for r in before.collect():
        found[r.doc_id] = [(m.start(), m.end(), m[g]) for p, g, least in SECRETS for m in re.finditer(p, r.text or "") if len(m[g]) >= least]
        for *_, value in found[r.doc_id]:
            owners.setdefault(value, set()).add(r.source)
    got = {r.doc_id: r for r in after.collect()}
    assert len(got) == before.count() and sum(map(bool, found.values())) > 0
    for r in before.collect():
        out, at = "", 0
        for a, z, value in sorted(found[r.doc_id]):
            if len(owners[value]) >= 3:
                continue
            if a >= at:
                out += r.text[at:a] + "[SECRET]"
            at = max(at, z)
        want = r.text if not at else out + r.text[at:]
        assert got[r.doc_id].text == want and got[r.doc_id].n_chars == (len(want) if at else r.n_chars)


def test_mix(steps):
    """Targets by filling up sources one by one, words by a tape of each source's documents."""
    import hashlib

    before, after = steps["mix"]
    docs = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in before.collect()]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in docs if x == s) for s in names}
    weight, total = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(size.values())
    target, open_, rest = {}, list(names), float(total)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * size[s]]
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else level * weight[s]
        rest -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    taken = {}
    for s in names:
        tape = [d for d, _, n in sorted((d for d in docs if d[1] == s), key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[2])) for _ in range(n)] * 3
        for d in tape[: round(round(target[s], 6))]:
            taken[d] = taken.get(d, 0) + 1
    got = {r.doc_id: r for r in after.collect()}
    assert len(got) == len(docs)
    for d, s, n in docs:
        assert (got[d]["size"], got[d].source_size, got[d].taken) == (n, size[s], taken.get(d, 0)) and abs(got[d].target - target[s]) < 1e-3


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels and a benchmark with nulls and repeated rows."""
    top = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 30)] * 2 + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (None, "alpha beta")], "item_id bigint, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def odd_rows():
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (None, "lonely text without an id", "en", "b", 5), (None, "lonely text without an id", "en", "b", 5), (None, None, None, None, None)]
    rows += [(4, "token = abcdefgh123 and more words here", "en", "a", 9)] * 2 + [(5, "long word " * 30_000, "en", "b", 1), (6, "one two three four five six seven eight nine ten", "en", "c", 1)]
    return rows + [(10 + k, f"plain text number {k} of the small table, with some words more {k * 7}", "en", f"s{k % 3}", 1) for k in range(20)]


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, tables, k):
    """Nulls, empty and long texts, repeated rows, ids that are null, columns with the names of results: nothing fails, rows stay what they were."""
    name, stage = corpus_pipeline.STAGES[k]
    more = ", hits int, spans string, live int, kept boolean, fp bigint, size int, taken int, nth int"
    docs = spark.createDataFrame([(*r, 1, "mine", 2, True, 3, 4, 5, 6) for r in odd_rows()], COLUMNS + more)
    got = stage(spark, docs, tables)
    rows = got.collect()
    if name == "mix":
        assert got.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and len(rows) == docs.count()
        return
    assert got.columns == docs.columns and all((r.spans, r.hits, r.fp, r.nth) == ("mine", 1, 3, 6) for r in rows)
    count = {"secrets": docs.count(), "decontaminate": docs.count() - 1}.get(name)
    assert count is None or len(rows) == count
    if name == "near_duplicates":
        ids = [r.doc_id for r in rows]
        assert ids.count(4) == 1 and ids.count(None) == 1 and set(range(10, 30)) <= set(ids)
    if name == "secrets":
        assert sum("[SECRET]" in (r.text or "") for r in rows) == 2


@pytest.mark.parametrize("k", range(5))
def test_stages_on_empty_tables(spark, tables, k, tmp_path):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.createDataFrame([], COLUMNS)
    assert stage(spark, docs, tables).count() == 0
    # An empty table beside documents that aren't.
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    some = spark.createDataFrame(odd_rows()[6:12], COLUMNS)
    got = stage(spark, some, str(tmp_path))
    assert got.count() == {"near_duplicates": 5}.get(name, 6)


def test_run(spark):
    """The whole pipeline gives what its stages give one by one, and leaves one folder behind."""
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    from normlake import session

    point = session.mark(spark)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and session.mark(spark) == point + 1
