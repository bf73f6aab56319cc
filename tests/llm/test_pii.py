"""Personal data: base spans against the stated patterns in Python; disclosive words on a fixture."""

import hashlib
import math
import random
import re

from matchlake.llm import pii
from matchlake.llm.common import AZ

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")),
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(t):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, t or "") if ok(k, m.group())]


SAMPLES = ["", None, "mail a.b+c@x-y.co.uk, again a@b.c_d@e.f and x@y@z.com 😀é me@d.org",
           "😀 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.0255 00000000000000000001.1.1.1 12345.1.1.1.1",
           "4111 1111 1111 1111, 4111-1111-1111-1111 and 41111111111111112 4465758382889437 4465758382889437",
           "4111  1111 1111 1111 1 4111111111111111 0000000000000000000 1-4111111111111111",
           "+1 (663) 555-6869 +12 +1((((( +49.30.1234567-8 +1234567890123456 +1 555 123 4567 8 9 99", "@@..+-1-2-3 a@b @c.d %@%.x",
           "a" * 50000 + "@x.yz " + "1" * 30000, "a@" + "b." * 20000 + "c", "9 " * 20000]


def check(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = [(pii.KINDS[s.kind], s.start, s.end) for s in got[i].spans if s.kind < 4]
        assert base == brute(t), (i, t and t[:200])
    return got


def test_base_spans(spark):
    got = check(spark, SAMPLES)
    assert got[1].sanitised is None and got[0].sanitised == ""
    assert got[2].sanitised.startswith("mail [EMAIL], again [EMAIL][EMAIL]")


def test_base_spans_random(spark):
    rnd = random.Random(5)
    parts = ["1", "23", "4111111111111111", "255", "+", ".", "-", " ", "@", "ab", "é", "(", ")", "_", "x.y", "😀", "7"]
    check(spark, ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(600)])


def docs_with_secret():
    filler = ["river", "stone", "cloud", "maple", "winter", "garden", "silver", "quiet", "morning", "letter"]
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    rows = [(i, say(30)) for i in range(200)]
    rows += [(300 + i, f"{say(6)} the zorblax works at jo@acme.org {say(6)}") for i in range(5)]  # five contexts
    rows += [(400, f"{say(4)} Zorblax alone {say(4)}")]
    rows += [(500 + i, "copied qwertz line of kim@acme.org here") for i in range(20)]             # one context
    return rows


def test_disclosive_terms(spark):
    df = spark.createDataFrame(docs_with_secret(), "doc_id bigint, text string")
    terms = {r.term: r for r in pii.disclosive_terms(df).collect()}
    assert "zorblax" in terms and "qwertz" not in terms and "river" not in terms
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert [s.kind for s in got[400].spans] == [4] and "orblax" not in got[400].sanitised
    text = dict(docs_with_secret())[400]
    s = got[400].spans[0]
    assert text[s.start:s.end] == "Zorblax"
    assert got[0].spans == [] and got[0].sanitised == dict(docs_with_secret())[0]
    assert "jo@acme.org" not in got[300].sanitised


def brute_terms(docs, generalise_at=0.75, min_contexts=3):
    """term -> disclosure, by plain loops over the definition (texts differ from each other)."""
    word = lambda t: [w.translate(AZ) for w in re.findall(r"[^\W_]{3,}", t)]
    seen, df_e, df_t = {}, {}, {}
    for row, text in enumerate(docs):
        spans = brute(text)
        blank = list(text)
        for _, s, e in spans:
            blank[s:e] = " " * (e - s)
        blank = "".join(blank)
        for w in set(word(blank)):
            df_t[w] = df_t.get(w, 0) + 1
        for k, s, e in spans:
            value = (k, text[s:e].translate(AZ) if k == "email" else text[s:e] if k == "ip" else re.sub("[^0-9]", "", text[s:e]))
            df_e.setdefault(value, set()).add(row)
            before, after = blank[max(0, s - 100):s], blank[e:e + 100]
            before = re.sub(r"^\S*", "", before) if s > 100 else before
            after = re.sub(r"\S*$", "", after) if len(after) == 100 else after
            context = tuple(dict.fromkeys(word(before + " " + after)))
            for w in context:
                seen.setdefault((value, w), {}).setdefault(text, set()).add(context)
    out, tested = {}, {}
    for value, _ in seen:
        tested[value] = tested.get(value, 0) + 1
    for (value, w), per in seen.items():
        # one context per document, by the smallest hash: only texts with one mention of the value are compared here
        co = len({next(iter(c)) for c in per.values()})
        n, e = len(docs), len(df_e[value])
        top = 2 ** (math.floor(math.log2(df_t[w])) + 1)
        rarer = (sum(x for x in df_t.values() if x < top) + 3) / sum(df_t.values())
        mean = e * df_t[w] / n
        tail = 1 - sum(math.exp(-mean) * mean ** i / math.factorial(i) for i in range(co - 1))
        evident = co >= min_contexts or (mean < 1 and tested[value] * rarer * tail <= pii.CHANCE)
        if evident and e < n:
            share = min(1.0, math.log2(n * co / (e * df_t[w])) / math.log2(n / e))
            if share >= generalise_at:
                out[w] = max(share, out.get(w, 0.0))
    return out


def test_disclosure_equals_brute_force(spark):
    rnd = random.Random(6)
    names = ["anna", "boris", "clara", "dieter", "emile", "the", "and", "mails", "street", "calls"]
    docs = []
    for _ in range(300):
        words = [rnd.choice(names) for _ in range(rnd.randint(10, 50))]
        if rnd.random() < 0.4:
            who = rnd.choice(["anna", "boris", "clara"])
            words.insert(rnd.randrange(len(words)), f"secret{who} {who}@mail.org code{who}")
        docs.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r.term: r.disclosure for r in pii.disclosive_terms(df).collect()}
    want = brute_terms(docs)
    assert set(got) == set(want) and want and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_clash_and_empty(spark):
    df = spark.createDataFrame([(1, "x@y.zz", 3, "q"), (1, "x@y.zz", 3, "q")], "doc_id bigint, text string, SPANS int, t string")
    got = pii.sanitise(df)
    assert got.columns == ["doc_id", "text", "t", "spans", "sanitised"] and got.count() == 2
    assert pii.sanitise(df.limit(0)).count() == 0


def test_query(spark):
    SF0001 = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in pii.op3_pii(spark, SF0001).collect()}
    src = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(src)
    for d in src:
        b = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(d.text))
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert rows[d.doc_id].spans.startswith(b)


def test_cards_with_every_digit_apart(spark):
    apart = " ".join("4111111111111111")
    got = check(spark, [apart, "no. " + apart.replace(" ", "-") + ".", "4 1 1 1", " ".join("4111111111111112")])
    assert [len(got[i].spans) for i in range(4)] == [1, 1, 0, 0] and got[1].sanitised == "no. [CARD]."


def test_copies_do_not_erase_evidence(spark):
    rnd = random.Random(7)
    say = lambda n: " ".join(rnd.choice(["river", "stone", "cloud", "maple", "winter"]) + str(rnd.randrange(9)) for _ in range(n))
    rows = [say(30) for _ in range(300)] + [f"{say(6)} zorblax writes to jo@acme.org {say(6)}" for _ in range(5)]
    same = f"{say(5)} zorblax writes to jo@acme.org {say(5)}"
    terms = lambda texts: {r.term: r.disclosure for r in pii.disclosive_terms(
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    once, often = terms([*rows, same]), terms([*rows, *[same] * 400])
    assert once["zorblax"] == 1 and set(once) == set(often) and all(abs(once[w] - often[w]) < 1e-9 for w in once)


def test_entities_seen_once_or_twice(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join(f"word{rnd.randrange(60)}" for _ in range(n))
    rows = [say(20) for _ in range(6000)] + [f"{say(3)} zorblax jo@acme.org {say(3)}", "Zorblax " + say(9)]
    rows += [f"{say(3)} quillon +49 30 1234567 {say(3)}" for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    terms = {r.term: r for r in pii.disclosive_terms(df).collect()}
    assert set(terms) == {"zorblax", "quillon"}         # not the words that stand everywhere
    n = len(set(rows))
    assert abs(terms["zorblax"].disclosure - math.log2(n / 2) / math.log2(n)) < 1e-9 and terms["quillon"].disclosure == 1
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "orblax" not in got[6000].sanitised + got[6001].sanitised and "quillon" not in got[6002].sanitised
    assert got[0].spans == [] and "word" in got[6000].sanitised


def test_few_contexts_equal_brute_force(spark):
    rnd = random.Random(9)
    say = lambda n: " ".join(f"word{rnd.randrange(40)}" for _ in range(n))
    docs = [f"{say(18)} n{i}" for i in range(1500)]
    for k, often in enumerate([1, 1, 2, 2, 3, 4]):          # entities with a rare word beside them, some of which stand elsewhere too
        docs += [f"{say(3)} secret{k} u{k}@mail.org {say(3)} a{i}" for i in range(often)]
        docs += [f"secret{k} {say(9)} b{i}" for i in range(k % 3 * 2)]
    docs += [f"{say(4)} rare{i}x v{i}@mail.org {say(4)}" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r.term: r.disclosure for r in pii.disclosive_terms(df).collect()}
    want = brute_terms(docs)
    assert set(got) == set(want) and len(want) >= 4 and all(abs(got[w] - want[w]) < 1e-6 for w in want)


def test_rare_words_beside_an_entity_seen_once_are_no_evidence(spark):
    rnd = random.Random(10)
    say = lambda n: " ".join(rnd.choice(["the", "and", "river"]) if rnd.random() < 0.7 else f"name{rnd.randrange(10 ** 6)}" for _ in range(n))
    docs = [say(30) for _ in range(800)] + [f"{say(10)} x{i}@mail.org {say(10)}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    assert pii.disclosive_terms(df).isEmpty()


def test_clean_documents_are_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = pii.sanitise(docs).select("text", "sanitised", "spans").collect()
    clean = [r for r in got if not brute(r.text)]
    assert len(clean) > 500 and sum(r.sanitised == r.text for r in clean) >= 0.95 * len(clean)


def test_very_many_spans_in_one_text(spark):
    one = "mail a@b.cd or +49 30 1234567, \u00e9 "
    text = one * 16_000                                       # 32,000 spans
    got = check(spark, [text])[0]
    assert got.sanitised == "mail [EMAIL] or [PHONE], \u00e9 " * 16_000


def test_running_sums_over_runs(spark):
    from pyspark.sql import functions as F
    rnd = random.Random(4)
    data = [[rnd.randrange(100) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 256, 1000)]
    df = spark.createDataFrame([(x,) for x in data], "x array<bigint>")
    got = df.select("x", pii._sums(F.col("x")).alias("s"), pii._scan(F.col("x"), lambda a, x: F.greatest(a, x), F.lit(0).cast("bigint")).alias("m")).collect()
    for r in got:
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))] and r.m == [max(r.x[:i], default=0) for i in range(len(r.x))]
