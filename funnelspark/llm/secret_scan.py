"""Secret scans: fixed patterns, and strings that look drawn at random.

Two first-order Markov models of characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples. A token is a secret if
the log-likelihood ratio of the two models, taken over the whole token, passes
a threshold. The models are an array of log ratios, indexed by a pair of ASCII
codes. Everything is a column expression; no Python runs on the executors.

Random samples are values that the fixed patterns find, and digests of the
words of a bounded sample of texts in the alphabets that keys are written in;
ordinary samples are the words of those texts, alone and joined as identifiers,
and decimal numbers, dates and rules of one character.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelspark.llm.common import bounded_rows, let, nested, replace_text, row_key

# The patterns, in the order in which spans at one place are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

#: Tokens of at least so many ASCII characters are scored. Those between dots, as in signed web tokens, are scored each on its own.
MIN_TOKEN = 16
TOKEN = rf"(?<![\p{{L}}\p{{N}}+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}(?![\p{{L}}\p{{N}}])"
#: Natural log of the odds against a secret that a token has to overcome.
MIN_RATIO = 12.0
#: Training reads at most so many rows, and makes samples of at most so many of their words.
TRAINING_ROWS = 1000
TRAINING_WORDS = 8000
ORDINARY, RANDOM = 0, 1
_BLOCK = 256


def _running_sums(values: Column) -> Column:
    """Sums of the values before each place, in blocks, so that long arrays cost no square."""
    return let(values, _block_sums)


def _block_sums(values: Column) -> Column:
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(_BLOCK)), lambda s: F.slice(values, s + 1, _BLOCK))

    def sums(array: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(array, state, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    zero = F.lit(0).cast("bigint")
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, sums(totals, zero)["out"], lambda b, s: sums(b, s)["out"]))


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, end, kind, found>> of the leftmost non-overlapping matches in code points.

    The text between matches comes from a split, so places follow from lengths.
    """
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,found:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), 2) if keep else found
    gaps = F.split(text, pattern, -1)
    length = lambda x: F.length(x).cast("bigint")
    steps = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("f")), lambda z: length(z["g"]) + F.coalesce(length(z["f"]), F.lit(0)))
    ends = F.arrays_zip(_running_sums(steps).alias("before"), gaps.alias("g"), found.alias("f"), value.alias("v"))
    whole = F.filter(ends, lambda z: z["f"].isNotNull() & ((F.length(z["v"]) >= MIN_VALUE) if keep else F.lit(True)))
    spans = F.transform(whole, lambda z: F.struct(
        (z["before"] + length(z["g"])).alias("start"), (z["before"] + length(z["g"]) + length(z["f"])).alias("end"),
        F.lit(kind).alias("kind"), z["v"].alias("found"),
    ))
    return F.when(text.rlike(pattern), spans).otherwise(nothing)


def base_spans(text: Column) -> list[Column]:
    return [_spans(text, ASSIGN, 0, keep=True), _spans(text, ACCESS, 1), _spans(text, HEX, 2)]


def labelled_samples(docs: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """(label, sample): ordinary words and identifiers, and random strings, from at most ``most`` texts of ``docs``."""
    drawn = bounded_rows(docs.select("doc_id", "text").filter("text IS NOT NULL"), row_key("doc_id", "text"), most).select("text")
    secrets = F.concat(*(F.transform(s, lambda x: x["found"]) for s in base_spans(F.col("text"))))
    clean = F.regexp_replace(F.regexp_replace(F.col("text"), HEX, " "), ASSIGN, " ")
    words = F.filter(F.split(clean, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & w.rlike("^[A-Za-z]+$"))
    rows = drawn.select(words.alias("w"), secrets.alias("s"))
    pairs = rows.select(F.explode(F.transform("w", lambda w, i: F.struct(w.alias("w"), F.get("w", i + 1).alias("following")))).alias("x")).select("x.*")
    word = bounded_rows(pairs.groupBy("w").agg(F.min("following").alias("following")), F.xxhash64("w"), TRAINING_WORDS)
    following = F.col("following")
    digest = F.sha2(F.concat_ws(" ", "w", following), 512)
    compact = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    number = F.conv(F.substring(digest, 1, 15), 16, 10)
    made = word.select(F.explode(F.array(
        *(F.struct(F.lit(ORDINARY).alias("label"), x.alias("sample")) for x in (
            F.col("w"), F.concat_ws("_", F.lower("w"), F.lower(following)), F.concat(F.lower("w"), F.initcap(following)),
            F.concat_ws("-", "w", following), F.upper(F.concat_ws("_", "w", following)), F.concat_ws("/", "w", following),
            number, F.concat_ws("-", F.substring(number, 1, 4), F.substring(number, 5, 2), F.substring(number, 7, 2)),
            F.repeat(F.substring("w", 1, 1), 20), F.repeat(F.lit("-"), 20), F.repeat(F.lit("="), 20), F.repeat(F.lit("_"), 20))),
        *(F.struct(F.lit(RANDOM).alias("label"), x.alias("sample")) for x in (
            F.substring(digest, 1, 40), F.substring(compact, 1, 40), F.substring(F.regexp_replace(compact, "[+/]", ""), 1, 32),
            F.substring(F.upper(F.regexp_replace(compact, "[+/]", "")), 1, 20), F.substring(F.translate(compact, "+/", "-_"), 1, 43))),
    )).alias("x")).select("x.*")
    return made.unionByName(rows.select(F.lit(RANDOM).alias("label"), F.explode("s").alias("sample"))).filter("length(sample) > 1")


def train(samples: DataFrame) -> list[float]:
    """Log ratios of the transitions, at 128 * first + second ASCII code, from (label, sample).

    The counts come to the driver: 128 x 128 rows at most.
    """
    chars = F.split("sample", "")
    codes = F.filter(F.transform(chars, lambda c: F.ascii(c)), lambda c: (c > 0) & (c < 128))
    pair = F.zip_with(F.slice(F.col("codes"), 1, F.size("codes") - 1), F.slice(F.col("codes"), 2, F.size("codes") - 1), lambda a, b: a * 128 + b)
    counted = samples.select("label", codes.alias("codes")).filter("size(codes) > 1").select("label", F.explode(pair).alias("pair"))
    table = counted.groupBy("pair").agg(*(F.count(F.when(F.col("label") == label, 1)).alias(f"n{label}") for label in (ORDINARY, RANDOM))).collect()
    n = {r["pair"]: (r["n0"], r["n1"]) for r in table}
    total = [[sum(n.get(128 * a + b, (0, 0))[label] for b in range(128)) for a in range(128)] for label in (ORDINARY, RANDOM)]
    # half a count for each of the 66 characters of a token, so that unseen transitions stay possible
    rate = lambda count, a, label: math.log((count[label] + 0.5) / (total[label][a] + 33.0))
    return [round(rate(c, i // 128, RANDOM) - rate(c, i // 128, ORDINARY), 4) for i in range(128 * 128) for c in [n.get(i, (0, 0))]]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of ASCII characters."""
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # the optimizer folds it to one literal
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    state = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] < 0, 0.0).otherwise(F.get(ratios, a["last"] * 128 + c))).alias("sum"))
    return F.aggregate(codes, state, step, lambda a: a["sum"])


def scan(docs: DataFrame, model: list[float] | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """``docs`` with column ``secrets``: array of (start, end, kind) in code points, ends exclusive, by start and kind.

    Kinds are those of KINDS by place: the three patterns, then tokens that the
    models take for random. Null and empty texts have none; equal spans of
    different kinds are both listed. Repeated rows get the same spans.
    """
    ratios = model if model is not None else train(labelled_samples(docs))
    tokens = _spans(F.col("text"), TOKEN, 3)
    random = F.filter(tokens, lambda x: ratio(x["found"], ratios) >= min_ratio)
    bare = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    every = F.concat(*map(bare, [*base_spans(F.col("text")), random]))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    spans = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return docs.withColumn("secrets", F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping secrets get one. Other columns stay.

    ``n_chars``, where there is one, follows the new text. Null texts stay null.
    """
    return nested(docs, lambda own: _redacted(own, mark, model))


def _redacted(docs: DataFrame, mark: str, model: list[float] | None) -> DataFrame:
    found = scan(docs, model).withColumn("_n", F.size("secrets"))
    # pieces of text that no span covers: between the furthest end so far and the next start
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    length = lambda a, x: (x["start"] - a["at"]).cast("int")
    step = lambda a, x: F.struct(
        F.greatest(a["at"], x["end"]).alias("at"),
        F.when(x["start"] >= a["at"], F.concat(a["out"], F.array(F.substring(F.col("text"), (a["at"] + 1).cast("int"), length(a, x)), F.lit(mark)))).otherwise(a["out"]).alias("out"),
    )
    pieces = F.aggregate("secrets", state, step, lambda a: F.concat(a["out"], F.array(F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))))
    text = F.when(F.col("_n") == 0, F.col("text")).otherwise(F.array_join(pieces, ""))
    return replace_text(found, text, F.col("_n") > 0)
