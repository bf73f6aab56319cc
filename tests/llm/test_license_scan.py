"""Licence scans: phrases against a plain search, matching statistics against substring search."""

import random

from matchlake.llm.license_scan import (PHRASES, TEMPLATES, Automaton, Scanner, op8_license_scan, scan_licenses,
                                        words_of)

SF0001 = "/root/testdata/sf0.001"


def brute_base(words):
    out = []
    for p, label in PHRASES.items():
        p = p.split()
        out += [(label, i) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return sorted(out)


def scanner():
    return Scanner(tuple(TEMPLATES), tuple(PHRASES.items()), 4, 12, 0.6)


def test_words():
    assert words_of("MIT-License É1_ab\x7fc") == ["mit", "license", "É1", "ab", "c"]


def test_matching_statistics():
    rnd = random.Random(4)
    strings = [[rnd.choice("abc") for _ in range(rnd.randint(1, 14))] for _ in range(8)]
    sam = Automaton(strings)
    joined = [" ".join(s) for s in strings]

    def inside(x):
        return any((" " + " ".join(x) + " ") in (" " + j + " ") for j in joined)
    for _ in range(60):
        text = [rnd.choice("abcd") for _ in range(40)]
        codes = [sam.vocab.get(w, -1) for w in text]
        for i, (v, n) in enumerate(sam.statistics(codes)):
            want = max((k for k in range(i + 2) if k == 0 or inside(text[i + 1 - k:i + 1])), default=0)
            assert n == want
            if n:
                ends = {(k, e) for k, s in enumerate(strings) for e in range(n - 1, len(s)) if s[e - n + 1:e + 1] == text[i + 1 - n:i + 1]}
                assert set(sam.ends[v]) == ends


def test_phrases_random():
    rnd, sc = random.Random(8), scanner()
    vocab = ["mit", "license", "apache", "general", "public", "the", "gnu", "x", "licensed", "under", "version"]
    for _ in range(400):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        assert sorted(sc.scan(words)[0]) == brute_base(words)


def test_spans():
    sc = scanner()
    mit = words_of(TEMPLATES[2][1])
    text = ["x"] * 7 + mit[:30] + ["odd", "words"] + mit[30:] + ["y"] * 5
    spans = sc.scan(text)[1]
    assert [(s[0], s[1], s[2]) for s in spans] == [("mit", 7, 7 + len(mit) + 1)] and spans[0][3] > 0.95
    assert sc.scan(mit[:20])[1] == []                   # a fifth of the template is no licence
    twice = sc.scan(words_of("Licensed under CC BY-NC 4.0. blah " * 2))[1]
    assert [s[0] for s in twice] == ["cc-by-nc"] * 2
    assert sc.scan(words_of("the copyright of the software and the license of any person"))[1] == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "The MIT License, MIT license", 1), (1, None, 2), (None, "", 3), (2, "word " * 40000, 4)],
                               "doc_id bigint, text string, N_WORDS int")
    got = scan_licenses(df)
    assert got.columns == ["doc_id", "text", "n_words", "base", "license_spans"]
    assert [(r.n_words, [(b.label, b.word) for b in r.base]) for r in got.collect()] == [
        (5, [("mit", 1), ("mit", 3)]), (0, []), (0, []), (40000, [])]
    assert scan_licenses(df.limit(0)).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in op8_license_scan(spark, SF0001).collect()}
    for d in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect():
        words, r = words_of(d.text), got[d.doc_id]
        base = brute_base(words)
        starts = [i for _, i in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def brute_hits(words, templates, min_words=4):
    """(template, text start, template start, words) of all stretches that can be extended to neither side."""
    out = set()
    for k, t in enumerate(templates):
        need = max(2, min(min_words, len(t)))
        for i in range(len(words)):
            for j in range(len(t)):
                if words[i] == t[j] and (i == 0 or j == 0 or words[i - 1] != t[j - 1]):
                    n = 0
                    while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                        n += 1
                    if n >= need:
                        out.add((k, i, j, n))
    return out


def test_every_template_gets_its_own_stretches(monkeypatch):
    rnd = random.Random(12)
    templates = [" ".join(rnd.choice("abcde") for _ in range(n)) for n in (3, 5, 9, 14, 20)]
    sc = Scanner(tuple((f"t{k}", t) for k, t in enumerate(templates)), (), 4, 12, 0.6)
    seen = []
    monkeypatch.setattr(sc, "_chain", lambda hits: seen.extend(hits) or [])
    for _ in range(300):
        words = [rnd.choice("abcdex") for _ in range(40)]
        at = rnd.randrange(20)
        words[at:at + 9] = rnd.choice(templates).split()[:9]
        seen.clear()
        sc.scan(words)
        assert sorted(seen) == sorted(brute_hits(words, [t.split() for t in templates])) and len(seen) == len(set(seen))


def test_a_short_notice_counts_where_another_template_goes_on():
    sc = scanner()
    spans = sc.scan(words_of('Licensed under the Apache License, Version 2.0 (the "License"); see LICENSE'))[1]
    assert ("apache", 0, 7, 1.0) in spans
    for text, label in (("Mozilla Public License Version 2.0", "mpl"), ("under the GNU Lesser General Public License or", "lgpl"),
                        ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form", "unlicense")):
        assert label in {s[0] for s in sc.scan(words_of(text))[1]}, label


def test_templates_are_read_as_data(spark, tmp_path):
    from matchlake.llm.license_scan import read_templates
    (tmp_path / "own.txt").write_text("you may do as you please with this")
    (tmp_path / "own--short.txt").write_text("do as you please")
    templates = read_templates(spark, str(tmp_path))
    assert templates == [("own", "do as you please"), ("own", "you may do as you please with this")]
    df = spark.createDataFrame([(1, "Well: do as you please.")], "doc_id bigint, text string")
    assert [s.label for s in scan_licenses(df, templates).first().license_spans] == ["own"]
