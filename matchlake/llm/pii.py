"""Information-theoretic sanitisation of personal data (DataFrame functions only).

1. Base entities: e-mail, IP, card and phone spans by pattern and check.
2. Corpus co-occurrence: for each entity value, the words around its mentions. Everything is
   counted over the N distinct texts (by their hash), so copies of a text neither add
   evidence nor take it away; contexts repeated verbatim in different texts are one piece of
   evidence. With df and co in distinct texts,
       IC(e) = log2(N / df(e)),  PMI(e; t) = log2(N * co(e, t) / (df(e) * df(t))),
   and ``PMI / IC`` is the share of the entity's information that the word reveals
   (1: whoever reads the word knows the entity). Every entity counts, also one seen once.
   With ``min_contexts`` different contexts the share stands as it is; with k fewer it must
   not be chance. Rare words stand everywhere in natural text, so the question is not whether
   this word would stand there but whether any word as rare would: of the words beside the
   entity (its ``tested``), the share F of all (text, word) incidences that words as rare
   hold is expected by chance, and each finds its way into k - 1 further contexts with the
   Poisson tail of E = df(e) * df(t) / N; tested * F * P(X >= k - 1) must be at most
   ``CHANCE``. F is bounded from above (words below the next power of two of df(t), and three
   more).
3. Words whose share reaches ``generalise_at`` are disclosive wherever they stand: they
   become spans of kind ``term``; from ``remove_at`` on they are removed, below replaced by
   their word class.

All counts cover all documents; nothing is sampled. Words are counted with map-side
combination; only disclosive words leave the documents again. Small tables (copied texts,
disclosive words, texts that hold one) are counted and broadcast up to a fixed number of rows;
beyond that they are joined by shuffle, with the same result.

Positions come from running sums in two levels (``_scan``) and texts are cut by way of
1024-character pieces, so a text with very many spans costs little more than its length.

Patterns use possessive quantifiers and run-start look-behinds: they accept exactly the
stated base patterns but never rescan a long run of digits or letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import az_lower, documents, identifier, keep_columns, small, spare, staged

# The four base kinds in order, as possessive forms of the stated patterns.
# card: a whole run of digits with single separators, 16 to 19 digits long.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "phone": "+"}   # a text without it has no such span
KINDS = list(PATTERNS)
WORD = r"[\p{L}\p{N}]{3,}"
RADIUS = 100          # code points of context on either side of a mention
CHANCE = 0.01         # of any word beside an entity being there by chance, where contexts are few
SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,label:string>>"
RESULT = ["spans", "sanitised"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def term(i):
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + term(i))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


RUN = 128


def _scan(values: Column, op, zero: Column) -> Column:
    """Exclusive running ``op`` over an array: what precedes each element. Runs of 128 elements
    and the totals of the runs before them, so n elements cost about 64 n steps."""
    def of(v):
        runs = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>"))
        part = lambda b, n: F.aggregate(F.slice(v, b * RUN + 1, n), zero, op)

        def inside(b, first):
            last = F.least(F.lit(RUN), F.size(v) - b * RUN) - 1
            return F.transform(F.sequence(F.lit(0), last), lambda j: op(first, part(b, j)))
        return _let(F.transform(runs, lambda b: part(b, F.lit(RUN))), lambda totals: F.flatten(F.transform(
            runs, lambda b: _let(F.aggregate(F.slice(totals, F.lit(1), b), zero, op), lambda first: inside(b, first)))))
    return _let(values, of)


def _sums(values: Column) -> Column:
    return _scan(values, lambda a, x: a + x, F.lit(0).cast("bigint"))


def _placed(hits: Column, gaps: Column, kind: int, label: Column) -> Column:
    """Spans from the matches and the stretches between them, in code points."""
    both = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"))

    def of(z):
        before = _sums(F.transform(z, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("bigint")))
        return F.transform(F.arrays_zip(z.alias("z"), before.alias("before")), lambda y: _let(
            y["before"] + F.length(y["z"]["gap"]), lambda s: F.struct(
                F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(y["z"]["hit"])).alias("end"),
                y["z"]["hit"].alias("value"), label.alias("label")))).cast(SPAN)
    return _let(both, of)


def _none() -> Column:
    return F.array().cast(SPAN)


def base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: base spans of column ``text`` by kind, then start."""
    made = []
    for k, kind in enumerate(KINDS):
        t, h = F.col(text), spare(df, f"{out}_{kind}")
        maybe = F.contains(t, F.lit(HINT[kind])) if kind in HINT else t.rlike(r"[0-9][\x20-]?[0-9]")
        df = df.withColumn(h, F.when(maybe, F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0))))
        found = _placed(F.col(h), F.split(t, PATTERNS[kind], -1), k, F.lit(kind.upper()))
        made.append((h, F.when(F.size(h) > 0, F.filter(found, _check(kind))).otherwise(_none())))
    return df.withColumn(out, F.concat(*[c for _, c in made])).drop(*[h for h, _ in made])


def term_spans(text: Column, gone: Column, general: Column) -> Column:
    """Spans of the words of ``text`` (lower-cased) that are in ``gone`` (label '') or ``general``
    (label TERM): its words are looked up one by one, with their places."""
    words = _placed(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1), 4, F.lit("TERM"))
    known = F.filter(words, lambda w: F.array_contains(F.concat(gone, general), w["value"]))
    return F.transform(known, lambda w: F.struct(w["kind"], w["start"], w["end"], w["value"], F.when(
        F.array_contains(gone, w["value"]), "").otherwise(w["label"]).alias("label"))).cast(SPAN)


PIECE = 1024


def _between(parts: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text given as pieces of 1024."""
    def of(a, z):
        tail = F.substring(F.element_at(parts, a + 1), (start % PIECE + 1).cast("int"), F.least(end - start, F.lit(PIECE)).cast("int"))
        head = F.when(end % PIECE > 0, F.substring(F.element_at(parts, z + 1), F.lit(1), (end % PIECE).cast("int"))).otherwise("")
        return F.when(a == z, tail).otherwise(F.concat(tail, F.array_join(F.slice(parts, a + 2, z - a - 1), ""), head))
    return F.when(end > start, of(F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int"))).otherwise("")


def replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with spans replaced by ``by(span)``; of overlapping spans the first is written."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("far"), s["kind"].alias("kind"), s["end"].alias("end"),
        s["label"].alias("label"))))

    def of(parts, o):
        ends = F.transform(o, lambda s: s["end"])
        at = _scan(ends, lambda a, x: F.greatest(a, x), F.lit(0).cast("bigint"))       # where what precedes a span ends
        one = lambda y: F.when(y["s"]["start"] >= y["at"], F.concat(
            _between(parts, y["at"], y["s"]["start"]), by(y["s"]))).otherwise("")
        done = F.array_join(F.transform(F.arrays_zip(o.alias("s"), at.alias("at")), one), "")
        return F.concat(done, _between(parts, F.array_max(ends), F.length(text).cast("bigint")))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(pieces, lambda parts: _let(order, lambda o: of(parts, o)))).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """Base spans overwritten by as many spaces: positions stay, their parts are no words."""
    return replaced(text, spans, lambda s: F.rpad(F.lit(""), (s["end"] - s["start"]).cast("int"), " "))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(az_lower(text), F.lit(WORD), F.lit(0)))


def _text(docs: DataFrame, text_col: str) -> DataFrame:
    """t (NULL: empty), its base spans s, and m: the text with those blanked."""
    base = base_spans(docs.select(F.coalesce(F.col(identifier(text_col)), F.lit("")).alias("t")), "t", "s")
    return base.select("t", "s", _blanked(F.col("t"), F.col("s")).alias("m"))


def _word_counts(docs: DataFrame, text_col: str, copied: DataFrame) -> DataFrame:
    """(term, df_t): distinct texts that hold a word. Rows that hold it, less the copies: a copied text's rows but one."""
    rows = _text(docs, text_col).select(F.explode(_words(F.col("m"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("x"))
    text = F.coalesce(F.col(identifier(text_col)), F.lit(""))
    again = (docs.select(_key(text).alias("key"), text.alias("t")).join(small(copied), "key")
             .groupBy("key", "rows").agg(F.first("t").alias("t")))
    again = (base_spans(again, "t", "s").select((1 - F.col("rows")).alias("x"), F.explode(_words(_blanked(F.col("t"), F.col("s")))).alias("term"))
             .groupBy("term").agg(F.sum("x").alias("x")))
    return staged(rows.unionByName(again).groupBy("term").agg(F.sum("x").alias("df_t")), "pii-words")


def disclosive_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = 0.75,
                     remove_at: float = 0.9, min_contexts: int = 3) -> DataFrame:
    """(term, disclosure, action): words that reveal an entity of the corpus.

    Evidence is ``min_contexts`` different contexts of one entity value, or fewer that are
    not chance (``CHANCE``).
    """
    text = F.coalesce(F.col(identifier(text_col)), F.lit(""))
    copied = docs.select(_key(text).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    copied = staged(copied.filter("rows > 1"), "pii-copied")
    total = docs.count() - (copied.agg(F.sum(F.col("rows") - 1)).first()[0] or 0)

    value = (F.when(F.col("x.kind") == 0, az_lower(F.col("x.value"))).when(F.col("x.kind") == 1, F.col("x.value"))
             .otherwise(_digits(F.col("x.value"))))
    # RADIUS code points on either side
    # words cut by the edge of the context are left out
    around = F.concat_ws(" ", F.when(F.col("x.start") > RADIUS, F.regexp_replace("before", r"^\S*", "")).otherwise(F.col("before")),
                         F.when(F.length("after") == RADIUS, F.regexp_replace("after", r"\S*$", "")).otherwise(F.col("after")))
    beside = F.transform("s", lambda x: _let(F.struct(x.alias("x")), lambda y: F.struct(
        y["x"].alias("x"), _between(F.col("parts"), F.greatest(y["x"]["start"] - RADIUS, F.lit(0).cast("bigint")), y["x"]["start"]).alias("before"),
        _between(F.col("parts"), y["x"]["end"], F.least(y["x"]["end"] + RADIUS, F.col("len"))).alias("after"))))
    mentions = (_text(docs, text_col).filter(F.size("s") > 0)
                .select(_key(F.col("t")).alias("doc"), "s", F.length("m").cast("bigint").alias("len"),
                        F.regexp_extract_all("m", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("parts"))
                .select("doc", F.explode(beside).alias("b")).select("doc", "b.*")
                .select("doc", F.concat_ws(":", F.col("x.kind").cast("string"), value).alias("entity"), _words(around).alias("words"))
                .withColumn("context", F.xxhash64(F.concat_ws(" ", "words"))))
    mentions = staged(mentions, "pii-mentions")
    entities = mentions.groupBy("entity", "doc").agg(F.lit(1).alias("x")).groupBy("entity").agg(F.count("x").alias("df_e"))
    pairs = (mentions.select("entity", "doc", "context", F.explode("words").alias("term"))
             .groupBy("entity", "term", "doc").agg(F.min("context").alias("context"))
             .groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("x"))
             .groupBy("entity", "term").agg(F.sum("x").alias("co"), F.count("x").alias("contexts")))
    pairs = staged(pairs, "pii-pairs")
    if pairs.isEmpty():          # no word beside an entity: nothing to count
        return pairs.select("term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action"))
    counts = _word_counts(docs, text_col, copied).withColumn("bin", F.floor(F.log2("df_t")))
    # F: share of all incidences held by words as rare, by powers of two (at most 63 rows)
    held = counts.groupBy("bin").agg(F.sum("df_t").alias("held"))
    upto = Window.orderBy("bin")
    rarer = held.select("bin", ((F.sum("held").over(upto) + 3) / F.sum("held").over(Window.partitionBy(F.lit(0)))).alias("rarer"))
    n = F.lit(float(total))
    ic = F.log2(n / F.col("df_e"))
    pmi = F.log2(n * F.col("co") / (F.col("df_e") * F.col("df_t")))
    tested = pairs.groupBy("entity").agg(F.count(F.lit(1)).alias("tested"))
    # P(X >= k - 1) for Poisson X, as the first term of the tail and a series that loses no digits
    mean, k = F.col("df_e") * F.col("df_t") / n, F.col("contexts").cast("double") - 1
    fact = F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(min_contexts)), F.lit(2), F.least("contexts", F.lit(min_contexts)).cast("int") - 1),
                       F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    tail = F.least(F.lit(1.0), F.exp(-mean + k * F.log(mean) - fact) * (1 + mean / (k + 1) * (1 + mean / (k + 2) * (1 + mean / (k + 3)))))
    chance = F.col("tested") * F.col("rarer") * F.when(k > 0, tail).otherwise(1.0)
    evident = (F.col("contexts") >= min_contexts) | ((mean < 1) & (chance <= CHANCE))
    share = (pairs.join(entities.join(tested, "entity"), "entity").join(counts, "term").join(F.broadcast(rarer), "bin")
             .filter((F.col("df_e") < n) & evident).groupBy("term").agg(F.max(F.least(pmi / ic, F.lit(1.0))).alias("disclosure")))
    return staged(share.filter(F.col("disclosure") >= generalise_at).select(
        "term", "disclosure", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action")),
        "pii-terms")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise_at: float = 0.75,
             remove_at: float = 0.9, min_contexts: int = 3) -> DataFrame:
    """``docs`` with ``spans`` (array of kind, start, end, value, label) and ``sanitised``.

    Kinds 0-3 are e-mail, IP, card, phone; 4 is a disclosive word. In ``sanitised`` base
    spans become ``[KIND]``, disclosive words ``[TERM]`` or nothing. A NULL text has no
    spans and stays NULL; an empty text stays empty; repeated rows are treated alike; an
    empty table gives an empty result. Input columns named like a result column give way.
    """
    terms = disclosive_terms(docs, id_col, text_col, generalise_at, remove_at, min_contexts)
    carried = keep_columns(docs, RESULT)
    df = docs.select(F.struct(*[F.col(identifier(c)) for c in carried]).alias("row"))
    df = df.withColumn("t", F.coalesce(F.col("row").getField(text_col), F.lit("")))
    df = base_spans(df, "t", "base")
    if terms.isEmpty():
        df = df.withColumn("spans", F.col("base"))
    else:
        hits = _text(docs, text_col).select(_key(F.col("t")).alias("key"), F.explode(_words(F.col("m"))).alias("term"))
        found = staged(hits.join(small(terms), "term").groupBy("key")
                       .agg(F.collect_set(F.when(F.col("action") == "remove", F.col("term"))).alias("gone"),
                            F.collect_set(F.when(F.col("action") != "remove", F.col("term"))).alias("general")), "pii-found")
        lowered = az_lower(_blanked(F.col("t"), F.col("base")))
        df = (df.withColumn("key", _key(F.col("t"))).join(small(found), "key", "left")
              .withColumn("spans", F.when(F.col("gone").isNull(), F.col("base")).otherwise(
                  F.concat("base", term_spans(lowered, F.col("gone"), F.col("general"))))))
    mark = lambda s: F.when(s["label"] == "", F.lit("")).otherwise(F.concat(F.lit("["), s["label"], F.lit("]")))
    clean = F.when(F.col("row").getField(text_col).isNotNull(), replaced(F.col("t"), F.col("spans"), mark))
    return df.select(*[F.col("row").getField(c).alias(c) for c in carried], "spans", clean.alias("sanitised"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    found = sanitise(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
                        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))
