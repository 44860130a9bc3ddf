"""Secrets in texts: three base patterns, and a battery of randomness tests for what the patterns miss.

Base kinds are ``assign`` (a named value), ``access`` (access key ids) and ``hex`` (long hexadecimal runs). The battery
looks at every other run of 20 or more key characters, and at the parts of 20 or more that are left when paths, prefixes
and dashes are cut off; of those found in one another the longest counts. It infers the encoding, then measures how
unlike running text and identifiers the run is: chi-squared uniformity over the encoding's alphabet, the number of runs of
one character kind (where there are several), and the serial correlation of neighbours. Which scores count as a discovery is settled per encoding and length class by
the false-discovery rule over the whole table, so a short run needs more evidence where many short runs are tested.

Positions are code points, ends exclusive. A null text counts as empty and has no spans. Rows are judged one by one, so
repeated rows get equal answers; of spans that begin alike the kinds' order decides, and there are no further ties. Very long
texts are searched whole. An empty table gives no rows. ``redact`` carries the caller's row in a struct, whatever its
columns are called, and sets text and n_chars; ``with_spans`` adds columns to a table of doc_id and text.
DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import carried

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"

#: Parts of a run: without dash and underscore (standard base64), without plus and slash (the URL's one), without separators.
PARTS = (r"[A-Za-z0-9+/]{20,}+={0,2}", r"[A-Za-z0-9_-]{20,}+={0,2}", r"[A-Za-z0-9+]{20,}+={0,2}")

KINDS = ("assign", "access", "hex", "random")

#: Encoding, what its runs look like, alphabet in order, and the null model of ordinary text in that alphabet: chance that
#: two characters are equal, that three are, and that the character kind changes from one character to the next (None: there is but one kind).
ENCODINGS = (
    ("digits", r"^[0-9]+$", "0123456789", 0.12, 0.018, None),
    ("letters", r"^([A-Z]?[a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz", 0.0655, 0.0063, None),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.10, 0.012, 0.2),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.0655, 0.0063, 0.2),
    ("base64", r"^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.0655, 0.0063, 0.4),
)

#: Lower ends of the length classes.
LENGTHS = (20, 28, 40, 64, 128)

#: A serial correlation beyond so many standard errors is not random.
SERIAL_LIMIT = 3.3

#: Width of a score class in units of -ln p, and the highest class.
STEP, TOP = 0.25, 2000

MARK = "[SECRET]"

SPANS = "array<struct<start:int,end:int,hit:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """Matches with their positions: lengths of the gaps and of the matches, added up."""
    pieces = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda hit, gap: F.struct(hit.alias("hit"), F.length(gap).alias("gap")))
    none = F.array().cast(SPANS)

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["gap"]
        end = start + F.length(piece["hit"])
        return F.struct(end.alias("at"), F.array_append(state["spans"], F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("hit"))).alias("spans"))

    walked = F.aggregate(F.filter(pieces, lambda p: p["hit"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda state: state["spans"])
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(none)


def _candidates(text: Column) -> Column:
    """Runs the battery tests, and their parts."""

    def cut(run: Column) -> Column:
        smaller = [F.filter(_spans(run["hit"], part), lambda s: F.length(s["hit"]) < F.length(run["hit"])) for part in PARTS]
        moved = F.transform(F.concat(*smaller), lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end"), s["hit"].alias("hit")))
        return F.when(F.regexp_like(run["hit"], F.lit("[+/_-]")), F.array_distinct(F.concat(F.array(run), moved))).otherwise(F.array(run))

    return F.flatten(F.transform(_spans(text, RUN), cut))


def _log_bound(k: Column, n: Column, p: float) -> Column:
    """-ln of the Chernoff bound of P(Binomial(n, p) >= k)."""
    share = k / n
    tail = F.when(share >= 1, F.lit(0.0)).otherwise((1 - share) * F.log((1 - share) / F.lit(1 - p)))
    return F.when(share <= p, F.lit(0.0)).otherwise(n * (share * F.log(share / F.lit(p)) + tail))


def _score(run: Column, name: str, alphabet: str, two: float, three: float, change: float | None) -> Column:
    """-ln p of the combined tests; 0 where the serial correlation speaks against randomness."""
    key = run if name != "base64" else F.translate(run, "-_", "+/")
    key = F.lower(key) if name in ("hex", "letters") else key
    n = F.length(key).cast("double")
    chars = F.split(key, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(key, c, F.lit(""))), F.lit(2)))
    # Chi-squared over the alphabet rises with the number of equal pairs, so its value under the null follows from theirs.
    size = len(alphabet)
    chi = squares * size / n - n
    pairs = n * (n - 1) / 2
    mean = (n + 2 * pairs * two) * size / n - n
    spread = F.sqrt(pairs * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two)) * 2 * size / n
    z = (mean - chi) / spread
    uniform = F.when(z > 0, z * z / 2 + F.log(F.lit(2.0))).otherwise(F.lit(0.0))
    values = F.transform(chars, lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    sq = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v * v)
    walk = F.aggregate(
        values, F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, v: F.struct(v.alias("last"), (acc["sum"] + acc["last"] * v).alias("sum")), lambda acc: acc["sum"],
    )
    average = total / n
    # Of the deviations' neighbour products, only the two ends differ from the plain sums.
    ends = F.element_at(values, 1) + F.element_at(values, -1)
    cross = walk - average * (2 * total - ends) + (n - 1) * average * average
    variance = sq - n * average * average
    serial = F.when(variance > 0, (cross / variance + 1 / n) * F.sqrt(n)).otherwise(F.lit(float("inf")))
    if change is None:
        fisher = uniform
    else:
        kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(run, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
        changes = F.length(F.regexp_replace(kinds, r"(.)\1*", "x")) - 1
        both = uniform + _log_bound(changes.cast("double"), n - 1, change)
        fisher = both - F.log(1 + both)
    return F.when(F.abs(serial) <= SERIAL_LIMIT, fisher).otherwise(F.lit(0.0))


def _tested(candidates: Column) -> Column:
    """Candidates with their stratum (encoding and length class) and score class; other runs are left out."""

    def test(span: Column) -> Column:
        run = F.rtrim(span["hit"], F.lit("="))
        length = F.length(run)
        klass = reduce(lambda acc, low: acc + (length >= low).cast("int"), LENGTHS[1:], F.lit(0))
        stratum, score = F.lit(None).cast("int"), F.lit(0.0)
        for k, (name, shape, *model) in reversed(list(enumerate(ENCODINGS))):
            fits = F.regexp_like(run, F.lit(shape))
            stratum = F.when(fits, klass + k * len(LENGTHS)).otherwise(stratum)
            score = F.when(fits, _score(run, name, *model)).otherwise(score)
        return F.struct(span["start"].alias("start"), span["end"].alias("end"), stratum.alias("stratum"), F.least(F.floor(score / STEP), F.lit(TOP)).cast("int").alias("score"))

    return F.filter(F.transform(candidates, test), lambda t: t["stratum"].isNotNull())


def thresholds(docs: DataFrame, rate: float = 0.01) -> dict[int, int]:
    """Lowest score class that counts as a discovery, per stratum, over all runs of the table.

    The false-discovery rule: among the m runs of a stratum, the lowest class whose bound e^(-class * STEP) is at most
    rate * (runs in it or above) / m. Only the counts per stratum and class meet, at most 25 * 2001 of them.
    """
    runs = docs.select(F.explode(_tested(_candidates(F.coalesce("text", F.lit(""))))).alias("t")).groupBy("t.stratum", "t.score").agg(F.count("*").alias("n"))
    above = Window.partitionBy("stratum").orderBy(F.desc("score"))
    ranked = runs.withColumn("above", F.sum("n").over(above)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
    good = ranked.where(F.exp(-F.col("score") * STEP) <= rate * F.col("above") / F.col("m"))
    return {r["stratum"]: r["score"] for r in good.groupBy("stratum").agg(F.min("score").alias("score")).collect()}


def with_spans(docs: DataFrame, limits: dict[int, int]) -> DataFrame:
    """``docs`` with a column __spans: array of (start, kind, end), kind an index of KINDS, in order of start and kind.

    The found arrays pass through a one-row generator each, because Spark would otherwise repeat their definitions
    inside every expression that reads them.
    """
    body = F.coalesce(docs["text"], F.lit(""))

    def of(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    assign = F.filter(_spans(body, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 6)
    base = F.concat(of(assign, 0), of(_spans(body, ACCESS), 1), of(_spans(body, HEX), 2))
    found = docs.select("*", F.explode(F.array(F.struct(base.alias("base"), _candidates(body).alias("runs")))).alias("__found"))
    if limits:
        least = F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))
        apart = F.filter(F.col("__found.runs"), lambda t: ~F.exists(F.col("__found.base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        random = F.filter(_tested(apart), lambda t: t["score"] >= F.coalesce(least[t["stratum"]], F.lit(TOP + 1)))
        found = found.select("*", F.explode(F.array(random)).alias("__random"))
        inside = lambda t, o: (o["start"] <= t["start"]) & (t["end"] <= o["end"]) & (o["end"] - o["start"] > t["end"] - t["start"])
        longest = F.filter("__random", lambda t: ~F.exists("__random", lambda o: inside(t, o)))
        spans = F.concat(F.col("__found.base"), of(longest, 3))
    else:
        spans = F.col("__found.base")
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array(F.array_sort(spans))).alias("__spans"))


def described(spans: Column, base_only: bool = False) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    chosen = F.filter(spans, lambda s: s["kind"] < 3) if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, limits: dict[int, int], mark: str = MARK) -> DataFrame:
    """``docs`` with every span replaced by a mark; overlapping spans become one. Texts without spans stay as they are.

    A column n_chars, if there is one, is counted anew for changed texts.
    """
    found = with_spans(carried(docs).select("row", "text"), limits)
    text = found["text"]

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        kept = F.concat(state["out"], F.when(fresh, F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise(F.lit("")))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), kept.alias("out"))

    clean = F.aggregate(
        found["__spans"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
        lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
    )
    has = F.size("__spans") > 0
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.when(has, clean).otherwise(text)
    if "n_chars" in columns:
        columns["n_chars"] = F.when(has, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.select(*(column.alias(name) for name, column in columns.items()))
