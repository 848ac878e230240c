"""Secret scans with DataFrame functions only.

Three patterns give the base spans. Further spans come from two character Markov models, one of random strings and one
of ordinary identifiers: a token whose log-likelihood ratios sum up to more than the prior odds against secrets is random. The models are
trained from labelled samples in the table itself: values that the patterns found are random strings, other words are
ordinary identifiers.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import unused, written

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# The alphabet of the models; capitals count as small letters.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{%d,}+"  # whole runs: a short one isn't tried again from each of its characters
LEAST_TOKEN = 12  # eleven transitions of a random string just outweigh PRIOR on average
PRIOR = 12.0  # log odds against a token being a secret; the sum of a token's log-likelihood ratios has to outweigh it
SHARE = 32  # of the texts without a base span one in so many gives samples of ordinary identifiers
BLOCK = 256

SPAN = "array<struct<start:int,rank:int,end:int,value:int,held:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, first: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The running folds of an array. Each block is folded from where the blocks before it end, so that no array grows by copies beyond a block."""

    def more(done: Column, last: Column) -> Column:
        return F.concat(done, F.array(last))

    def folds(blocks: Column) -> Column:
        heads = F.aggregate(blocks, F.array(first), lambda done, b: more(done, F.aggregate(b, F.element_at(done, -1), add)))
        each = lambda b, head: F.slice(F.aggregate(b, F.array(head), lambda done, x: more(done, add(F.element_at(done, -1), x))), 2, F.size(b))
        return F.flatten(F.zip_with(blocks, F.slice(heads, F.lit(1), F.size(blocks)), each))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
    return _let(values, lambda v: _let(cut(v), folds))


def _spans(text: Column, pattern: str, rank: int, value_group: int = 2) -> Column:
    """Array of (start, rank, end, length of the value, value) of the matches, leftmost and not overlapping, in code points.

    \\G holds each match to the end of the one before, so that the text between matches is the first group, and
    running sums of lengths give the places.
    """
    pattern = rf"(?s)\G(.*?)({pattern})"
    groups = {"gap": 1, "found": 2} | ({"held": value_group} if value_group != 2 else {})
    held = "held" if value_group != 2 else "found"

    def spans(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.length(p["gap"]) + F.length(p["found"]))
        ends = _running(lengths, F.lit(0), lambda s, n: s + n)
        return F.zip_with(parts, ends, lambda p, end: F.struct((end - F.length(p["found"])).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.length(p[held]).alias("value"), p[held].alias("held")))

    return _let(F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(name) for name, k in groups.items()]), spans)


def _where(matches: Column, spans: Column) -> Column:
    return F.when(matches, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All spans of the three patterns that are long enough, as an array of (start, rank, end, value, held) in this order."""
    assign = _where(text.rlike(ASSIGN), F.filter(_spans(text, ASSIGN, 0, 3), lambda x: x["value"] >= LEAST_VALUE))
    # A run shorter than the least length holds no longer one, so the least length can stand in the pattern.
    access = f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}+"
    hexes = f"[0-9a-f]{{{LEAST_HEX},}}+"
    return F.array_sort(F.concat(assign, _where(text.rlike(access), _spans(text, access, 1)), _where(text.rlike(hexes), _spans(text, hexes, 2))))


def _overlaps(span: Column, starts: Column, reach: Column) -> Column:
    """Whether a span overlaps one of those with the ascending `starts`; `reach` is the running maximum of their ends. A binary search for the last one that starts before the span's end."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(30))])
    before = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(starts, n + step - 1) < span["end"], n + step).otherwise(n))
    return F.coalesce(F.get(reach, before - 1) > span["start"], F.lit(False))


def _transitions(samples: DataFrame) -> DataFrame:
    """(label, pair, n): how often two characters of ALPHABET follow each other in the samples of a label."""
    chars = F.split(F.lower("sample"), "")
    pairs = F.zip_with(F.slice(chars, 1, F.length("sample") - 1), F.slice(chars, 2, F.length("sample") - 1), lambda a, b: F.concat(a, b))
    return samples.where(F.length("sample") > 1).select("label", F.explode(pairs).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def train(found: DataFrame, text: str = "text", spans: str = "base") -> list[float] | None:
    """Log-likelihood ratios of the transitions at 128 first + second, random strings against ordinary identifiers.

    The labelled samples: the values of base spans are random strings, the words outside of them ordinary identifiers. What
    reaches the driver is one count for each pair of ALPHABET and label. As a random string may be of any alphabet, while the
    values may all be of one (hexadecimal, say), the random model is half the values', half uniform. None if there is no sample of either label.
    """
    values = found.select(F.lit(1).alias("label"), F.explode(F.transform(F.col(spans), lambda x: x["held"])).alias("sample"))
    words = found.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(F.regexp_replace(text, f"{ASSIGN}|{ACCESS}|[0-9a-f]{{{LEAST_HEX},}}+", " "), F.lit(TOKEN % 4), F.lit(0))).alias("sample"))
    counts = {(label, pair): n for label, pair, n in _transitions(values.unionByName(words)).where(F.col("pair").rlike(r"^[a-z0-9+/_=-]{2}$")).collect()}
    if not any(label for label, _ in counts) or all(label for label, _ in counts):
        return None
    ratios = [0.0] * (128 * 128)
    for a in ALPHABET:
        totals = [sum(counts.get((label, a + b), 0) for b in ALPHABET) + 0.5 * len(ALPHABET) for label in (0, 1)]
        for b in ALPHABET:
            ordinary, random = ((counts.get((label, a + b), 0) + 0.5) / totals[label] for label in (0, 1))
            ratios[128 * ord(a) + ord(b)] = math.log((random + 1 / len(ALPHABET)) / 2 / ordinary)
    return ratios


def _ratio(token: Column, ratios: list[float]) -> Column:
    """Sum of the log-likelihood ratios of the token's transitions."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")  # folded to one literal of 128 x 128 numbers
    n = F.length(token) - 1
    terms = lambda c: F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), lambda a, b: F.get(table, a * 128 + b))
    return _let(F.transform(F.split(F.lower(token), ""), F.ascii), lambda c: F.aggregate(terms(c), F.lit(0.0), lambda s, x: s + x))


def secret_spans(docs: DataFrame, prior: float = PRIOR) -> DataFrame:
    """`docs` with the column `spans`: array of (start, rank, end, value) by start, then kind; KINDS[rank] names the kind.

    Places are code points, end exclusive; value is the length of the secret itself, at the span's end. Base spans: see
    base_spans. A markov span is a run of LEAST_TOKEN or more letters, digits, `+`, `_` and `-`, with a letter (others are numbers
    or rules), that overlaps no base span and whose log-likelihood ratios sum up to `prior` or more; so `/`, `=` and `.` part
    runs, and each part is judged by itself. Null and empty texts have none. Rows that repeat a doc_id each give a row; an
    empty table gives an empty table. A column of `docs` that is named `spans` is replaced. Time is linear in a text's length
    but for a sort of its spans.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    told = F.col("text").rlike(f"{ASSIGN}|AKIA|[0-9a-f]{{{LEAST_HEX}}}") | (F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0)
    ratios = train(written(docs.select(text.alias("text")).where(told).withColumn("base", base_spans(F.col("text"))), "samples"))
    base = base_spans(text)
    bare = lambda x: F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "value")])
    if ratios is None:
        return docs.withColumn("spans", F.transform(base, bare))
    token = TOKEN % LEAST_TOKEN
    random = lambda run: run.rlike("[A-Za-z]") & (_ratio(run, ratios) >= prior)
    # Most texts hold none; only the others are searched for places.
    some = F.exists(F.regexp_extract_all(text, F.lit(token), F.lit(0)), random)
    likely = F.filter(_spans(text, token, 3), lambda x: random(x["held"]))
    apart = lambda spans, base: _let(
        F.struct(F.transform(base, lambda b: b["start"]).alias("starts"), _running(F.transform(base, lambda b: b["end"]), F.lit(0), lambda m, end: F.greatest(m, end)).alias("reach")),
        lambda at: F.filter(spans, lambda x: ~_overlaps(x, at["starts"], at["reach"])),
    )
    held, more = unused(docs, "base"), unused(docs, "likely")
    found = docs.select("*", base.alias(held), _where(some, likely).alias(more))
    kept = F.when(F.size(more) > 0, apart(F.col(more), F.col(held))).otherwise(F.col(more))
    return found.withColumn("spans", F.array_sort(F.transform(F.concat(held, kept), bare))).drop(held, more)


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"], x["end"])), ",")
