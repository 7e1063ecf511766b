"""Cases in which an operator once did less than the whole job."""

import random

import pytest
from normlake.llm import op4_simhash, op6_pii

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau ypsilon phi chi psi omega".split()


def alike(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y) >= 0.8


@pytest.mark.parametrize("block", [256, 4])
def test_near_copies_are_verified(spark, block):
    """Texts of one bag of words are proposed together; only those alike by five-word shingles are one component."""
    r, rows = random.Random(3), []
    words = [w for w in WORDS if len(w) >= 5] * 4
    for _ in range(6):
        r.shuffle(words)
        was = list(words)
        for _ in range(6):
            # A chain of copies: swapping two neighbours keeps the bag and changes six shingles of forty or fewer.
            rows.append(" ".join(was))
            at = r.randrange(len(was) - 1)
            was = was[:at] + [was[at + 1], was[at]] + was[at + 2 :]
        rows.append(" ".join(words).upper())
    rows += ["Paris is big We saw art ate well and had fun", "I do not like Paris too hot too dear and the bus was late", "!!!", "???", "", " "]
    order = r.sample(range(len(rows)), len(rows))
    df = spark.createDataFrame([(k, rows[j]) for k, j in enumerate(order)], "doc_id bigint, text string")
    texts, root = [rows[j] for j in order], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if texts[i].strip() == texts[j].strip() or (texts[i].strip("! ?") and texts[j].strip("! ?") and alike(texts[i], texts[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = op4_simhash.near_copies(spark, df, block=block).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == list(enumerate(root))
    assert len(set(root)) >= 11


def test_dedup_keeps_texts_that_share_a_long_word(spark):
    rows = [(1, "Paris is big. We saw art, ate well, and had fun."), (2, "I do not like Paris: too hot, too dear, and the bus was late."), (3, "Paris is big. We saw art, ate well, and had fun!")]
    assert len({tuple(op4_simhash.wide_prints(t)) for _, t in rows}) == 1
    kept = op4_simhash.dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(x.doc_id for x in kept.collect()) == [1, 2]


def test_pii_signs_alone():
    """A disguise is found whatever other words the text has."""
    for t, want in [("write to jane (at) example.com please", "jane (at) example.com"), ("mail jane at example.com now", "jane at example.com"), ("jane@example (dot) com", "jane@example (dot) com"), ("für jane [ät] example.org", "jane [ät] example.org"), ("JANE [ÄT] EXAMPLE [PUNKT] ORG", "JANE [ÄT] EXAMPLE [PUNKT] ORG")]:
        base, found = op6_pii.all_spans(t)
        assert want in [t[a:b] for k, a, b in found if k == 0] and (0, t.index(want), t.index(want) + len(want)) not in base, t


def test_pii_spelled_between_signs_beyond_ascii():
    t = "“plus\u00a0one\u00a0two\u00a0three\u2003four\u00a0five\u00a0six\u00a0seven\u00a0eight\u00a0nine”"
    assert (3, 1, len(t) - 1) in op6_pii.all_spans(t)[1]


def test_pii_long_runs():
    for t in ("at " + "x" * 200_000, "at" + " " * 200_000 + "x"):
        assert op6_pii.all_spans(t) == ([], [])


def test_pii_mixed_spellings():
    for t, kind, want in [("at one two seven dot zero dot zero dot one now", 1, "one two seven dot zero dot zero dot one"), ("call +49 one seven six 555 12 34 567 ok", 3, "+49 one seven six 555 12 34 567"), ("ip 10 dot 0 punkt null dot 5.", 1, "10 dot 0 punkt null dot 5"), ("john at mail.example.com", 0, "john at mail.example.com"), ("four one one one 1111 one one one one 1111", 2, "four one one one 1111 one one one one 1111")]:
        assert (kind, want) in [(k, t[a:b]) for k, a, b in op6_pii.all_spans(t)[1]], t
    for t in ("un deux point trois", "neun neun, acht 555 1212 3", "one dot, two dots", "chapter one, 2 or three"):
        assert op6_pii.all_spans(t) == ([], []), t


def test_pii_round_trip():
    """Identifiers disguised at random in foreign text: every span comes back as it was planted."""
    r = random.Random(11)
    names, look = "zero one two three four five six seven eight nine".split(), {v: k for k, v in op6_pii._LOOK.items()}
    ascii_look = {c: k for c, k in look.items() if c.isalpha()}

    def spelled(digits, sep=" "):
        return sep.join(names[int(c)] for c in digits)

    def disguised():
        kind = r.randrange(4)
        if kind == 0:
            name, host, tld = ("".join(r.choices("abcdefgh", k=r.randrange(3, 8))) for _ in range(3))
            at, dot = r.choice([" at ", " (at) ", "[at]", "@"]), r.choice([" dot ", " (dot) ", "[punkt]", "."])
            if at == " at " or dot != " dot ":
                made = f"{name}{at}{host}{dot}{tld}"
            else:
                made = f"{name}{at}{host}.{tld}"
            if r.random() < 0.4:
                k = r.randrange(len(name))
                made = made[:k] + ascii_look.get(made[k], made[k]) + made[k + 1 :]
            return 0, made
        if kind == 1:
            return 1, r.choice([" dot ", " punkt "]).join(spelled(str(r.randrange(256))) if r.random() < 0.7 else str(r.randrange(256)) for _ in range(4))
        if kind == 2:
            digits = [r.randrange(10) for _ in range(15)]
            total = sum(d if k % 2 else (2 * d - 9 * (2 * d > 9)) for k, d in enumerate(reversed(digits)))
            number = "".join(map(str, digits)) + str(-total % 10)
            return 2, " ".join(spelled(number[k : k + 4]) if r.random() < 0.6 else number[k : k + 4] for k in range(0, 16, 4))
        number = "".join(str(r.randrange(10)) for _ in range(r.randrange(9, 14)))
        return 3, r.choice(["plus ", "+"]) + spelled(number, r.choice([" ", ", ", "\u00a0"])) if r.random() < 0.5 else f"+{number[:2]} {spelled(number[2:5])} {number[5:]}"

    for _ in range(3000):
        kind, made = disguised()
        before, after = "Über das Maß hinaus: ", "; Füße und so weiter"
        t = before + made + after
        assert (kind, len(before), len(before) + len(made)) in op6_pii.all_spans(t)[1], (kind, made, op6_pii.all_spans(t))
