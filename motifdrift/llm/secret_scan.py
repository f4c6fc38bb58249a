"""Secret scan with DataFrame functions only: fixed patterns, and two character Markov models.

The patterns find well-formed secrets. Their values, and the long tokens of the corpus that are made of words, are the labelled samples
that train two first-order character models: of random strings and of ordinary identifiers. A long token outside
every pattern is a secret when its log-likelihood ratio under the two is high. Counts cover all documents.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifdrift.llm.shared import text_or_empty, written

#: Fixed values of the contract: kind, pattern, which group must have how many characters.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of [A-Z0-9] or [0-9a-f] that is too short fails from all its later starts too, so the length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

TOKEN = "[A-Za-z0-9+/_-]"
SAMPLE_LEAST = 12
SCORED_LEAST = 16
LONG = rf"(?<!{TOKEN}){TOKEN}{{{SAMPLE_LEAST},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Long tokens made of words, capitals or numbers are the ordinary samples; others, which may be secrets, train nothing.
ORDINARY = r"^(?:[_/+-]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++))++$"
#: The random model leans to uniform, by so many counts for each character; the ordinary one falls back on how often the
#: second character comes at all, by so many counts in all, so what it has never seen is unlikely.
RANDOM_PRIOR, ORDINARY_PRIOR = 8.0, 4.0
#: In nats: of a whole token, and of each of its steps.
LEAST_RATIO, LEAST_RATIO_A_STEP = 12.0, 0.5

SPAN = "struct<s:int,k:int,e:int,v:string>"
#: Running values are formed in levels of so many: FAN to the power of LEVELS is 2^30, and a text of 2^31 bytes has fewer matches, as each has 6 letters or more.
FAN, LEVELS = 32, 6


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array, all values up to it joined. Every level joins FAN stretches of the one before, n log n steps in all; an array
    that grows by one would be copied each time."""

    def level(values: Column, span: int) -> Column:
        before = lambda p, i: F.when(i >= span, F.sequence(F.lit(1), F.least(F.lit(FAN - 1), F.floor(i / span).cast("int"))))
        whole = lambda p: F.transform(p, lambda x, i: F.coalesce(F.aggregate(before(p, i), x, lambda t, j: join(t, F.get(p, i - j * span))), x))
        return bound(values, lambda p: F.when(F.size(p) > span, whole(p)).otherwise(p))

    def deeper(values: Column) -> Column:
        for k in range(1, LEVELS):
            values = level(values, FAN**k)
        return values

    return bound(level(values, 1), lambda p: F.when(F.size(p) > FAN, deeper(p)).otherwise(p))


def found(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches as structs: start, kind, end (code points), value. Ends are sums over the matches and the pieces between them."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("val")), lambda x: x["hit"].isNotNull())

    def spans(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, b: a + b)
        one = lambda x, e: F.struct((e - F.length(x["hit"])).alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["val"].alias("v"))
        return F.zip_with(p, ends, one).cast(f"array<{SPAN}>")

    return F.when(text.rlike(pattern), bound(pieces, spans)).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def outside(spans: Column, base: Column) -> Column:
    """The spans that overlap none of base. In order of position, a span overlaps if a base span that begins before its end reaches beyond its start."""
    point = lambda at, kind, reach, x: F.struct(at.alias("at"), F.lit(kind).alias("is_base"), reach.alias("reach"), x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v"))
    points = F.array_sort(F.concat(F.transform(spans, lambda x: point(x["e"], 0, F.lit(-1), x)), F.transform(base, lambda x: point(x["s"], 1, x["e"], x))))

    def kept(p: Column) -> Column:
        reach = running(F.transform(p, lambda x: x["reach"]), F.greatest)
        free = bound(reach, lambda r: F.filter(p, lambda x, i: (x["is_base"] == 0) & (F.get(r, i) <= x["s"])))
        return F.transform(free, lambda x: F.struct(x["s"], x["k"], x["e"], x["v"])).cast(f"array<{SPAN}>")

    return F.when((F.size(spans) == 0) | (F.size(base) == 0), spans).otherwise(bound(points, kept))


def matched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base: the pattern spans; long: the long tokens that overlap none of them."""
    text = F.col("_text")
    base = F.concat(
        F.filter(found(text, ASSIGN, 0, 2), lambda x: F.length(x["v"]) >= ASSIGN_LEAST), found(text, ACCESS, 1), found(text, HEX, 2)
    )
    return (
        docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
        .select("doc_id", F.array_sort(base).alias("base"), found(text, LONG, 3).alias("long"))
        .select("doc_id", "base", outside(F.col("long"), F.col("base")).alias("long"))
    )


def places(token: Column) -> Column:
    """The place of each character in the alphabet, from 1; 0 for others. The token is split once."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def step_counts(samples: DataFrame) -> DataFrame:
    """label, a, b, n: how often character class b follows a in the samples (label, token). Equal tokens are counted once first."""
    steps = bound(places(F.col("token")), lambda p: F.transform(F.sequence(F.lit(0), F.length("token") - 2), lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b"))))
    return (
        samples.groupBy("label", "token").agg(F.count("*").alias("n"))
        .filter(F.length("token") > 1)
        .select("label", "n", F.explode(steps).alias("step"))
        .groupBy("label", "step.a", "step.b").agg(F.sum("n").alias("n"))
    )


def labelled(spans: DataFrame) -> DataFrame:
    """Samples (label, token): 1 for values of the patterns, 0 for ordinary long tokens. Parts of values outside the alphabet split them."""
    one = lambda name, label, least: spans.select(F.explode(name).alias("x")).select(
        F.lit(label).alias("label"), F.explode(F.regexp_extract_all(F.col("x.v"), F.lit(rf"{TOKEN}{{{least},}}"), F.lit(0))).alias("token")
    )
    return one("base", 1, 2).unionByName(one("long", 0, SAMPLE_LEAST).filter(F.col("token").rlike(ORDINARY)))


def log_ratios(counts: list[tuple[int, int, int, int]]) -> list[float]:
    """For characters a, b of the alphabet, at place a * size + b (0: any other): log P_random(b | a) / P_ordinary(b | a)."""
    size = len(ALPHABET) + 1
    n = {(label, a, b): c for label, a, b, c in counts}
    rows = {(label, a): sum(n.get((label, a, b), 0) for b in range(size)) for label in (0, 1) for a in range(size)}
    alone = [sum(n.get((0, a, b), 0) for a in range(size)) + 0.5 for b in range(size)]
    share = [x / sum(alone) for x in alone]
    random = lambda a, b: (n.get((1, a, b), 0) + RANDOM_PRIOR) / (rows[1, a] + RANDOM_PRIOR * size)
    ordinary = lambda a, b: (n.get((0, a, b), 0) + ORDINARY_PRIOR * share[b]) / (rows[0, a] + ORDINARY_PRIOR)
    return [log(random(a, b) / ordinary(a, b)) for a in range(size) for b in range(size)]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (s start, k kind, e end), by start and then kind; spans also has the random tokens.

    A null text counts as empty and has no spans. Repeated rows and ids give a row each. Equal starts are ordered by kind, then
    end. Without samples of both kinds nothing is added. An empty table gives no rows. Other columns
    are not read. A text may be of any length: it is matched whole, in time that grows with n log n of its length and matches.
    """
    spans = written(matched(docs, id_col, text_col), "secret-spans")
    counts = [tuple(r) for r in step_counts(labelled(spans)).collect()]  # at most 2 x (alphabet + 1) squared rows
    size = len(ALPHABET) + 1
    values = ", ".join(f"{x:.6f}D" for x in log_ratios(counts)) if {c[0] for c in counts} == {0, 1} else "0D"
    ratio = lambda p, i: F.coalesce(F.get(F.col("ratios"), F.get(p, i - 1) * size + F.get(p, i)), F.lit(0.0))
    total = lambda v: bound(places(v), lambda p: F.aggregate(F.sequence(F.lit(1), F.length(v) - 1), F.lit(0.0), lambda t, i: t + ratio(p, i)))
    judged = F.transform(F.filter("long", lambda x: F.length(x["v"]) >= SCORED_LEAST), lambda x: F.struct(x["s"], x["k"], x["e"], total(x["v"]).alias("r")))
    kept = F.filter(judged, lambda x: x["r"] >= F.greatest(F.lit(LEAST_RATIO), LEAST_RATIO_A_STEP * (x["e"] - x["s"] - 1)))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["s"], x["k"], x["e"]))
    return (
        spans.withColumn("ratios", F.expr(f"array({values})"))
        .select("doc_id", bare("base").alias("base"), bare(kept).alias("more"))
        .select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))
    )


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scanned(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans")
    )
