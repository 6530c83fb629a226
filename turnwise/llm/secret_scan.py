"""Secret scanning with SQL functions only.

Method: character Markov models. Two first-order models, one of random strings and one of ordinary identifiers, are trained
from labelled samples; a run of key-like characters is reported when the log-likelihood ratio of the two models says random,
or else those of its parts for which it does: pieces between separators, and stretches of the greatest running sum.
Beside it stand three fixed forms (an assignment to a secret-like name, an access key id, a long hexadecimal run), whose
findings are always kept.

Training samples: random strings are digests of a counter, written in hexadecimal and base 64; ordinary identifiers are
the words of a bounded sample of about ``SAMPLE_DOCS`` documents without fixed-form findings, and a list of words
common in code, joined in snake, kebab and camel case. The models are two tables of character pairs, at most 67 x 67 numbers, which travel as a literal.

Plan: one scan without a shuffle and without Python. Two regular expressions decide whether a text holds any finding at
all; only then are places worked out, as running sums of the lengths of matches and of the gaps between them.

Defined results: null text counts as empty; positions are code points, ends exclusive; findings are sorted by start and
then by kind in the order of ``KINDS``; of a Markov finding that overlaps a fixed-form one, what lies outside it and
looks random is left; repeated rows are
scanned alike; an empty table gives no rows; further columns are ignored by :func:`scan_documents` and kept by
:func:`redact`.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import text_or_empty

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A greedy run is all there is of a match, so its least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Key-like runs: what the Markov models judge. Access keys and hexadecimal runs are among them.
RUN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"
MIN_VALUE = 6

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
SAMPLE_DOCS = 300
RANDOM_STRINGS = 3000
#: A run is reported when its log-likelihood ratio is at least so many nats in all, and so many per pair.
MIN_TOTAL, MIN_MEAN = 14.0, 0.8
#: Characters between which the pieces of a run stand; the least length of a run and of a part of it.
SEPARATORS, MIN_RUN = "/=_+-", 20
MASK = "[SECRET]"
# Ordinary words of identifiers, joined in pairs for training.
WORDS = (
    "access account action active address array author average before begin between block board branch bridge brown buffer build button "
    "cache call change channel check child class clear client close cloud code column command complete config connect content context "
    "control count create current customer data date default delete detail device dialog display document domain double download edit "
    "element enable error event example execute export failed fetch field file filter finish first float folder format found fox frame "
    "function general generate global group handle handler header height hidden history home image import index info input insert instance "
    "integer invalid item jump jumps key label language last layout length level library limit list load local location login lower "
    "manager map match max memory menu message method min model module mount name native network next node number object open option "
    "order output over owner page panel parameter parent parse password path pattern photo picture player point policy position previous "
    "price print process product profile project property provider public query queue quick random range read record refresh region "
    "register remote remove render report request reset resource response result return role root save schema scope screen script search "
    "section select send sequence server service session settings shape share size source space start state status storage stream string "
    "style submit success summary support switch symbol system table target task template test text theme thread time timeout title token "
    "tool total track transaction transfer tree trigger type unique unit unknown update upload upper user value variable vector version "
    "video view visible warning watch weight width window word worker write xml year yield zero zone"
).split()

_SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


#: Identifiers of a fixed random form, which aren't secrets.
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"

#: Of each run: its place, its text and the ratio of every pair of neighbours.
_RATED = f"""transform(transform(__runs, x -> named_struct('x', x, 'codes', transform(split(x.v, ''), c -> instr('{ALPHABET}', c)))), y -> named_struct(
    's', y.x.s, 'v', y.x.v, 'r', transform(sequence(2, size(y.codes)), i -> element_at(__ratios, (y.codes[i - 2] - 1) * {len(ALPHABET)} + y.codes[i - 1]))))"""


def _random(pairs: str) -> str:
    """SQL: whether an array of ratios reaches the thresholds."""
    return f"aggregate({pairs}, 0D, (a, p) -> a + p) >= greatest({MIN_TOTAL}D, {MIN_MEAN}D * size({pairs}))"


_NONE = "cast(array() AS array<struct<f:int,t:int>>)"
#: Pieces between separators, as places in the run, ends exclusive.
_PIECES = f"""filter(aggregate(split(y.v, '[{SEPARATORS}]', -1), named_struct('at', 0, 'out', {_NONE}),
    (a, w) -> named_struct('at', a.at + length(w) + 1, 'out', concat(a.out, array(named_struct('f', a.at, 't', a.at + length(w))))), a -> a.out),
    w -> w.t - w.f >= {MIN_RUN} AND {_random("slice(y.r, w.f + 1, w.t - w.f - 1)")})"""
#: Parts that a running sum finds, which starts anew when it falls to nothing or far below its best; widened to separators.
_NEXT = f"a.sum + x.p - {MIN_MEAN / 2}D"
_FOUND = f"if(a.to > a.at AND {_random('slice(y.r, a.at + 1, a.to - a.at + 1)')}, concat(a.out, array(named_struct('f', a.at, 't', a.to + 2))), a.out)"
_SEGMENTS = f"""filter(transform(aggregate(transform(y.r, (p, i) -> named_struct('p', p, 'i', i)), named_struct('sum', 0D, 'at', 0, 'best', 0D, 'to', -1, 'out', {_NONE}),
    (a, x) -> CASE WHEN {_NEXT} <= 0 OR {_NEXT} < a.best - {MIN_TOTAL}D THEN named_struct('sum', 0D, 'at', x.i + 1, 'best', 0D, 'to', -1, 'out', {_FOUND})
        ELSE named_struct('sum', {_NEXT}, 'at', a.at, 'best', greatest(a.best, {_NEXT}), 'to', if({_NEXT} > a.best, x.i, a.to), 'out', a.out) END, a -> {_FOUND}),
    w -> named_struct('f', w.f - length(regexp_extract(substring(y.v, 1, w.f), '[^{SEPARATORS}]*$', 0)), 't', w.t + length(regexp_extract(substring(y.v, w.t + 1), '^[^{SEPARATORS}]*', 0)))),
    w -> w.t - w.f >= {MIN_RUN})"""
#: The random parts of each run: all of it, or else pieces and segments, those that meet as one.
_PARTS = f"""transform(__rated, y -> named_struct('s', y.s, 'v', y.v, 'r', y.r, 'parts', if({_random("y.r")}, array(named_struct('f', 0, 't', length(y.v))),
    aggregate(array_sort(concat({_PIECES}, {_SEGMENTS})), {_NONE}, (a, w) -> if(size(a) > 0 AND element_at(a, -1).t >= w.f,
        concat(slice(a, 1, size(a) - 1), array(named_struct('f', element_at(a, -1).f, 't', greatest(element_at(a, -1).t, w.t)))), concat(a, array(w)))))))"""
#: What lies outside the base findings; of parts that these cut, what looks random itself, with its neighbours.
_LEFT = "concat(a.out, array(named_struct('f', a.at, 't', {})))"
_OUTSIDE = f"""flatten(transform(__parts, y -> transform(filter(flatten(transform(y.parts, w ->
    aggregate(filter(base, b -> b.s < y.s + w.t AND b.e > y.s + w.f), named_struct('at', w.f, 'out', {_NONE}),
        (a, b) -> named_struct('at', greatest(a.at, b.e - y.s), 'out', if(b.s - y.s > a.at, {_LEFT.format("b.s - y.s")}, a.out)),
        a -> if(a.at < w.t, {_LEFT.format("w.t")}, a.out)))),
    w -> exists(y.parts, x -> x.f = w.f AND x.t = w.t) OR aggregate(slice(y.r, greatest(w.f, 1), w.t - greatest(w.f, 1) + 1), named_struct('sum', 0D, 'n', 0),
        (a, p) -> named_struct('sum', a.sum + p, 'n', a.n + 1), a -> a.sum >= {MIN_MEAN}D * a.n)),
    w -> named_struct('s', y.s + w.f, 'k', 3, 'e', y.s + w.t, 'v', substring(y.v, w.f + 1, w.t - w.f)))))"""


def training_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(random boolean, text): labelled strings to train on."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    strings = F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.substring(digest, 1, 32), F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(digest, F.lit("x")).cast("binary"), 512))), r"[\n=]", ""))
    drawn = spark.range(RANDOM_STRINGS).select(F.lit(True).alias("random"), F.explode(strings).alias("text"))
    share = min(1.0, sample_docs / max(1, docs.count()))
    text = text_or_empty()
    some = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < share * 1_000_003).where(~text.rlike(RUN) & ~text.rlike(ASSIGN))
    words = some.select(F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), 0).alias("w")).where("size(w) > 1")
    joined = words.select(F.explode(F.array(F.array_join("w", "_"), F.array_join("w", "-"), F.array_join(F.transform("w", lambda x: F.initcap(x)), ""))).alias("text"))
    known = F.array(*map(F.lit, WORDS))
    n = len(WORDS)
    other = lambda step: known[F.pmod(F.col("id") * step + F.floor(F.col("id") / n), F.lit(n)).cast("int")]
    three = [other(1), other(7), other(31)]
    few = F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")
    capital = [F.initcap(x) for x in three]
    styles = [
        F.concat_ws("_", *three), F.concat_ws("-", *three), F.concat(three[0], *capital[1:]), F.concat(*capital), F.concat(*three),
        F.upper(F.concat_ws("_", *three)), F.upper(F.concat_ws("-", *three)), F.upper(F.concat(*three)), F.concat_ws("_", *capital), F.concat_ws("-", *capital),
        F.concat_ws("/", *three), F.concat(F.lit("/"), F.concat_ws("/", *capital)), F.concat_ws("/", three[0], F.concat_ws("_", *three[1:]), few),
        F.concat_ws("_", *three, few), F.concat(*capital, few), F.upper(F.concat_ws("_", *three, few)), F.concat(three[0], few, capital[1], three[2]),
        F.concat_ws("-", F.lit("2024"), few, three[0]), F.concat(F.lit("="), F.concat_ws("==", *three)), F.concat_ws("__", F.lit(""), *three), F.concat(three[0], F.lit("+"), three[1]),
        F.concat_ws("/", F.lit(""), F.substring(three[0], 1, 3), F.concat(F.substring(three[1], 1, 2), few), F.substring(three[2], 1, 4), F.concat(three[0], few)),
        F.concat(F.upper(F.substring(three[0], 1, 3)), capital[1], F.upper(F.substring(three[2], 1, 2)), capital[0]),
    ]
    listed = spark.range(RANDOM_STRINGS).select(F.explode(F.array(*styles)).alias("text"))
    ordinary = joined.unionByName(listed)
    return drawn.unionByName(ordinary.select(F.lit(False).alias("random"), "text"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """The log-likelihood ratios of random against ordinary for every pair of ``ALPHABET``, by row; add-one smoothing."""
    chars = training_samples(docs, sample_docs).select("random", F.split("text", "").alias("c"))
    pairs = chars.selectExpr("random", "explode(transform(sequence(0, greatest(size(c) - 2, 0)), i -> concat(c[i], c[i + 1]))) AS pair")
    found = {(r[0], r[1]): r[2] for r in pairs.where(F.length("pair") == 2).groupBy("random", "pair").count().collect()}
    ratios = []
    for a in ALPHABET:
        total = {kind: sum(found.get((kind, a + b), 0) for b in ALPHABET) + len(ALPHABET) for kind in (True, False)}
        ratios += [math.log((found.get((True, a + b), 0) + 1) / total[True]) - math.log((found.get((False, a + b), 0) + 1) / total[False]) for b in ALPHABET]
    return [round(x, 6) for x in ratios]


def _spans(pattern: str, kind: int, value: int = 0) -> Column:
    """Every match of ``pattern`` in column ``text``: start, kind, end and the text of group ``value``."""
    text, p = F.col("text"), F.lit(pattern)
    found = F.arrays_zip(
        F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, p, 0))).alias("gap"),
        F.regexp_extract_all(text, p, 0).alias("hit"),
        F.regexp_extract_all(text, p, value).alias("value"),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), x["value"].alias("v"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    none = F.array().cast(_SPANS)
    return F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])


def find_secrets(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """Add ``base`` and ``added`` to ``docs`` (with column ``text``, not null): sorted arrays of (s, k, e, v)."""
    none = F.array().cast(_SPANS)
    base_cols = docs.withColumn("__run", F.col("text").rlike(RUN)).withColumn("__assign", F.col("text").rlike(r"[:=]") & F.col("text").rlike(ASSIGN))
    assign = F.filter(_spans(ASSIGN, 0, 2), lambda x: F.length(x["v"]) >= MIN_VALUE)
    base = F.array_sort(F.concat(F.when(F.col("__assign"), assign).otherwise(none), F.when(F.col("__run"), F.concat(_spans(ACCESS, 1), _spans(HEX, 2))).otherwise(none)))
    with_base = base_cols.withColumn("base", base)
    runs = with_base.withColumn("__runs", F.when(F.col("__run"), F.filter(_spans(RUN, 3), lambda x: ~x["v"].rlike(UUID))).otherwise(none))
    rated = runs.withColumn("__ratios", F.from_json(F.lit(json.dumps(ratios)), "array<double>")).withColumn("__rated", F.expr(_RATED))
    parts = rated.withColumn("__parts", F.expr(_PARTS))
    added = parts.withColumn("added", F.expr(_OUTSIDE))
    return added.drop("__run", "__assign", "__runs", "__ratios", "__rated", "__parts")


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ratios: list[float] | None = None) -> DataFrame:
    """One row per document of ``docs`` (``doc_id``, ``text``): its findings, counted and listed."""
    ratios = ratios or train(docs)
    found = find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), ratios)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, ratios: list[float] | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask`` and ``n_chars``, if there is one, set anew.

    Overlapping and touching findings become one mask; texts without findings, nulls among them, stay as they are.
    """
    ratios = ratios or train(docs)
    whole = docs.withColumn("__old", F.col("text")).withColumn("text", text_or_empty())
    kept = [c for c in docs.columns if c != "text"]
    carried = whole.select(F.struct(*[F.col(c) for c in kept]).alias("__row"), "__old", "text")
    found = find_secrets(carried, ratios).withColumn("__all", F.array_sort(F.concat("base", "added")))

    def step(state: Column, x: Column) -> Column:
        fresh = x["s"] > state["at"]
        more = F.when(fresh | (state["at"] == 0), F.concat(F.col("text").substr(state["at"] + 1, F.greatest(x["s"] - state["at"], F.lit(0))), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), F.concat(state["out"], more).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("__all", start, step, lambda s: F.concat(s["out"], F.col("text").substr(s["at"] + 1, F.length("text"))))
    done = found.withColumn("__new", F.when(F.size("__all") == 0, F.col("__old")).otherwise(masked))
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.col("__new").alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.size("__all") == 0, F.col("__row.n_chars")).otherwise(F.length("__new")).cast(docs.schema["n_chars"].dataType).alias(c))
        else:
            out.append(F.col("__row")[c].alias(c))
    return done.select(*out)
