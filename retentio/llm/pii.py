r"""Personal data: base patterns and bootstrapped contextual extraction, built
of DataFrame functions only.

*Base.*  E-mail, IP, card and phone by pattern and check, leftmost and
non-overlapping per kind, at code-point positions (end exclusive).  A match is
extracted together with the gap before it, so the lengths give its place.

*Bootstrapping.*  Candidates are runs of ASCII letters, digits, ``_`` and
``-`` with at least ``MIN_DIGITS`` digits that no base span touches.  The base
matches are seed instances.  Each instance, seed or candidate, occurs after
lexical patterns: the two words before it, whole whatever their length, and the word before it if it ends
like a label (``:``, ``=`` or ``#``).  Patterns with at least ``SUPPORT``
instances of score ``CONFIDENT``, seeds or candidates of an earlier round, are
scored by the mean score of their distinct instances (one more counts as a
miss), instances by the noisy-or of their confident patterns; this is repeated
over the whole pattern-instance graph, at least ``ROUNDS`` times and until a
round adds no value.  Scores only rise, so it ends.  Candidates that reach
``CONFIDENT`` become spans of kind ``id``.  The graph is joined and
pre-aggregated as tables; nothing of it is collected.

Null text counts as empty: no spans.  Rows that repeat a doc_id, or
have none, are judged by their own texts.  An empty table gives an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen, text_or_empty

MIN_DIGITS = 5
SUPPORT = 3
CONFIDENT = 0.75
ROUNDS = 3
KINDS = ("email", "ip", "card", "phone", "id")

# the base patterns, with possessive runs and starts only where a run starts or
# the last match ended, so that long runs take linear time
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_CANDIDATE = rf"(?<![A-Za-z0-9_-])(?=(?:[A-Za-z_-]*+[0-9]){{{MIN_DIGITS}}})[A-Za-z0-9_-]++"
#: what a text must have for a kind's pattern to be tried
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "id": "[0-9]"}

_DIGITS = "regexp_replace(m.value, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(m.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(ltrim('0', p) AS int), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND aggregate(transform(sequence(1, length({_DIGITS})), "
            f"i -> int(substring({_DIGITS}, -i, 1)) * (2 - i % 2)), 0, (s, d) -> s + if(d > 9, d - 9, d)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "id": "true",
}
_SPANS = "array<struct<start: bigint, end: bigint, value: string, before: string>>"


def _last_words(gap: Column) -> Column:
    """The last two words of a gap, whole; reversed, they stand at its start, where a pattern needs no search."""
    return F.reverse(F.regexp_extract(F.reverse(gap), r"^\s*(\S+(?:\s+\S+)?)", 1))


def _matches(kind: str, pattern: str) -> Column:
    """Spans of a kind's pattern in ``text``, before its check."""
    gaps = F.regexp_extract_all("text", F.lit(f"(?s)\\G(.*?)({pattern})"), 1)
    values = F.regexp_extract_all("text", F.lit(f"(?s)\\G(.*?)({pattern})"), 2)
    pairs = F.arrays_zip(gaps.alias("gap"), values.alias("value"))
    spans = F.aggregate(
        pairs, F.struct(F.lit(0).cast("bigint").alias("at"), F.expr(f"cast(array() AS {_SPANS})").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["gap"]) + F.char_length(p["value"])).alias("at"),
            F.concat(s["out"], F.array(F.struct(
                (s["at"] + F.char_length(p["gap"])).alias("start"),
                (s["at"] + F.char_length(p["gap"]) + F.char_length(p["value"])).alias("end"),
                p["value"].alias("value"), _last_words(p["gap"]).alias("before")))).alias("out")),
        lambda s: s["out"])
    return F.when(F.col("text").rlike(_HINTS[kind]), spans).otherwise(F.expr(f"cast(array() AS {_SPANS})"))


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, version (tells apart texts under one doc_id), valid base spans by kind, and candidates.
    All that is read of the texts; the table is written once and both steps take it."""
    text = text_or_empty("text")
    found = docs.select("doc_id", F.xxhash64(text).alias("version"), text.alias("text"))
    patterns = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "id": _CANDIDATE}
    found = found.select("doc_id", "version", *[_matches(k, p).alias(f"{k}_all") for k, p in patterns.items()])
    return frozen(found.select("doc_id", "version", *[F.expr(f"filter({k}_all, m -> {_VALID[k]})").alias(k)
                                                      for k in KINDS[:4]], F.col("id_all").alias("candidates")))


def _patterns(before: Column) -> Column:
    words = F.split(F.lower(before), r"\s+")
    last, second = F.element_at(words, -1), F.try_element_at(words, F.lit(-2))
    return F.filter(F.array(F.concat_ws(" ", second, last), F.when(last.rlike("[:=#]$"), last)),
                    lambda p: p.isNotNull() & (p != ""))


def _occurrences(spans: DataFrame) -> DataFrame:
    """doc_id, version, start, end, value, seed, patterns: base matches and candidates."""
    seen = spans.select("doc_id", "version", F.concat(*KINDS[:4]).alias("seeds"), "candidates")
    free = F.expr("filter(candidates, c -> NOT exists(seeds, s -> s.start < c.end AND c.start < s.end))")
    both = seen.select("doc_id", "version", F.concat(
        F.transform("seeds", lambda s: F.struct(s.alias("s"), F.lit(True).alias("seed"))),
        F.transform(free, lambda s: F.struct(s.alias("s"), F.lit(False).alias("seed")))).alias("all"))
    one = both.select("doc_id", "version", F.explode_outer("all").alias("o")).where("o IS NOT NULL")
    return one.select("doc_id", "version", F.col("o.s.start").alias("start"), F.col("o.s.end").alias("end"),
                      F.col("o.s.value").alias("value"), F.col("o.seed").alias("seed"),
                      _patterns(F.col("o.s.before")).alias("patterns"))


def _discover(spans: DataFrame, support: int, confident: float, rounds: int) -> DataFrame:
    """doc_id, version, start, end, value of candidates that confident patterns point at."""
    seen = frozen(_occurrences(spans))
    edges = (seen.select(F.explode("patterns").alias("pattern"), "value", "seed")
             .groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    known = edges.groupBy("pattern").agg(F.count_if("seed").alias("seeds"), F.count("*").alias("instances"))
    # only patterns that can have enough support and lead to something else can ever tell anything
    useful = known.where((F.col("instances") >= support) & (F.col("instances") > F.col("seeds"))).select("pattern", "instances")
    edges = frozen(edges.select("pattern", "value").join(useful, "pattern"))
    seeds = frozen(seen.where("seed").select("value").distinct().withColumn("score", F.lit(1.0)))
    scores, turn, before, found = seeds, 0, -1, 0
    while turn < rounds or found > before:
        supported = F.count_if(F.col("score") >= confident) >= support
        confidence = (edges.join(scores, "value").groupBy("pattern")
                      .agg((F.sum("score") / (F.max("instances") + 1)).alias("confidence"), supported.alias("supported"))
                      .where(F.col("supported") & (F.col("confidence") >= confident)).select("pattern", "confidence"))
        # noisy-or over the confident patterns of each instance
        reached = (edges.join(confidence, "pattern").groupBy("value")
                   .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")))
        scores = frozen(seeds.unionByName(reached).groupBy("value").agg(F.max("score").alias("score")))
        turn, before, found = turn + 1, found, scores.where(F.col("score") >= confident).count()
    accepted = scores.where(F.col("score") >= confident).select("value")
    return (seen.where("NOT seed").select("doc_id", "version", "start", "end", "value")
            .join(accepted, "value", "left_semi"))


def personal_data(docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, version and spans by kind (arrays of start, end, value, before): email, ip, card, phone, id."""
    base = _spans(docs)
    found = (_discover(base, support, confident, rounds).distinct().groupBy("doc_id", "version")
             .agg(F.sort_array(F.collect_list(F.struct("start", "end", "value", F.lit("").alias("before")))).alias("id")))
    found = found.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"), "id")
    return (base.drop("candidates").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
            .drop("_id", "_version").withColumn("id", F.coalesce("id", F.expr(f"cast(array() AS {_SPANS})"))))


def listed(kinds) -> Column:
    """kind:start:end of the spans, by kind as given, then start, comma-joined."""
    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(named, kinds)), ",")


def redact(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, overlapping spans by that of the first;
    n_chars, if there is one, follows the new text.  Rows and columns stay as they are."""
    spans = personal_data(docs, **settings)

    def of(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.sort_array(F.concat(*map(of, KINDS)))
    marked = (spans.select("doc_id", "version", every.alias("spans")).where(F.size("spans") > 0)
              .dropDuplicates(["doc_id", "version"]))
    # the input's columns travel as one, so their names cannot clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(marked, F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
                       & (F.xxhash64(text_or_empty("row.text")) == F.col("version")), "left")
    # what each span leaves to cut: nothing of it before the furthest end so far
    ends = F.expr("transform(spans, (s, i) -> coalesce(array_max(transform(slice(spans, 1, i), x -> x.end)), 0L))")
    parts = F.expr("transform(spans, (s, i) -> if(s.start >= ends[i], "
                   "concat(substring(row.text, int(ends[i]) + 1, int(s.start - ends[i])), '[', s.kind, ']'), ''))")
    tail = F.expr("substring(row.text, int(array_max(transform(spans, s -> s.end))) + 1)")
    new = F.when(F.size("spans") > 0, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col("row.text"))
    out = joined.withColumn("ends", ends).withColumn("new", new)
    columns = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.size("spans") > 0, F.char_length("new").cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
