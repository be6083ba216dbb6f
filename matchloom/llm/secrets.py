"""Secret scans: key patterns, and sliding-window entropy over candidate strings. Column expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import table

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
#: The key patterns; `+` takes all it can, and what is too short then is dropped.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Candidate strings of the entropy scan, and the characters of its window.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_-]{20,}={0,2}", 20
#: Least entropy in bits a character (log2 20 = 4.32 at most), by the character class of a piece: the first whose pattern fits all of it.
CLASSES = (
    ("digits", r"[0-9]+", 2.6),
    ("hexadecimal digits", r"(?=.*[0-9])[0-9a-fA-F]+", 3.2),
    ("letters of one case", r"[a-z]+|[A-Z]+", 4.0),
    ("digits and letters of one case", r"(?=.*[0-9])(?:[0-9a-z]+|[0-9A-Z]+)", 3.6),
    ("names and others without a digit", r"[^0-9]+|[A-Za-z]+(?:[_-][A-Za-z]+)*+[_-]?[0-9]{0,4}", 3.8),
    ("all others", r".*", 3.9),
)
#: A window of the class of names has as many changes between small and capital letters at least.
NAMES, CHANGES = 4, 6
#: Pieces that are no secrets.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
#: What cuts a candidate into pieces: placeholders with 40 characters on either side, runs of one character; names in a path.
GAPS = (r"(?i).{0,40}(?:example|placeholder|xxxx|your[_-]).{0,40}", r"(.)\1{7,}")
PATH, STEP = r"^[^/]*/[^/]*/[^/]*/", r"(?<![^/])(?=[^/]{1,19}(?:/|$))[A-Za-z]*[0-9]*(?:[_-][A-Za-z]*[0-9]*)*+(?![^/])"
#: Elements of an array that a running value goes through at once.
RUN = 256


def bound(value: Column, of) -> Column:
    """of(value), where value is computed once, however often `of` uses it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def running(values: Column, start: int, op) -> Column:
    """For each of an array of ints, op of `start` and all up to it: of RUN elements at a time, so arrays are not copied for each."""
    empty = F.expr("cast(array() as array<int>)")

    def step(acc: Column, x: Column) -> Column:
        new = op(acc["at"], x)
        return F.struct(new.alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

    def part(v: Column, acc: Column, i: Column) -> Column:
        done = F.aggregate(F.slice(v, i * RUN + 1, F.lit(RUN)), F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["parts"], F.array(d["out"])).alias("parts")))

    def over(v: Column) -> Column:
        zero = F.struct(F.lit(start).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("parts"))
        parts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        return F.when(F.size(v) > 0, F.aggregate(parts, zero, lambda acc, i: part(v, acc, i), lambda acc: F.flatten(acc["parts"]))).otherwise(empty)

    return bound(values, over)


def _spans(hits: Column, gaps: Column, keep) -> Column:
    """array<struct<start, end>> of matches and what lies between them, in code points; keep(match) tells which stay."""
    steps = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.length(h) + F.length(g))
    ends = F.zip_with(hits, running(steps, 0, lambda a, b: a + b), lambda h, e: F.struct(h.alias("hit"), e.alias("end")))
    return F.transform(F.filter(ends, lambda x: keep(x["hit"])), lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), x["end"].alias("end")))


def windows(s: Column, window: int = WINDOW) -> Column:
    """struct<entropy, mixed> of an ASCII string: the largest Shannon entropy, in bits, of any `window` characters in a
    row, and the same of those with CHANGES changes between small and capital letters or more; 0 where there are none.

    One pass over the string's codes keeps the window's sum of n log2 n and its changes of case; a step changes only
    the counts of the character that comes in and of the one that leaves, which it takes from the window itself.
    """
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c))
    share = [n * math.log2(n) if n else 0.0 for n in range(window + 1)]
    more = F.array(*[F.lit(b - a) for a, b in zip(share, share[1:])])  # what one more of n characters adds to the sum
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("sum", "entropy", "mixed")], F.lit(0).alias("changes"))

    def change(c: Column, i: Column) -> Column:
        a, b = F.get(c, i - 1), F.get(c, i)
        small, capital = (lambda x: (x >= 97) & (x <= 122)), (lambda x: (x >= 65) & (x <= 90))
        return F.when((small(a) & capital(b)) | (capital(a) & small(b)), 1).otherwise(0)

    def over(c: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            full = i >= window
            inside = F.slice(c, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))  # the window before the step
            into, out = F.get(c, i), F.get(c, i - window)
            left = F.size(F.filter(inside, lambda x: x == out))
            had = F.size(F.filter(inside, lambda x: x == into)) - (full & (into == out)).cast("int")
            total = acc["sum"] + F.get(more, had) - F.when(full, F.get(more, left - 1)).otherwise(0.0)
            changes = acc["changes"] + change(c, i) - F.when(full, change(c, i - (window - 1))).otherwise(0)
            entropy = F.when(i >= window - 1, F.log2(F.lit(float(window))) - total / window).otherwise(0.0)
            mixed = F.when(changes >= CHANGES, entropy).otherwise(0.0)
            return F.struct(total.alias("sum"), F.greatest(acc["entropy"], entropy).alias("entropy"), F.greatest(acc["mixed"], mixed).alias("mixed"), changes.alias("changes"))

        return F.aggregate(F.sequence(F.lit(0), F.size(c) - 1), zero, step, lambda acc: F.struct(acc["entropy"].alias("entropy"), acc["mixed"].alias("mixed")))

    return bound(codes, over)


def _piece_is_secret(s: Column) -> Column:
    least = F.lit(None).cast("struct<of: int, bits: double>")
    for k, (_, pattern, bits) in reversed(list(enumerate(CLASSES))):
        least = F.when(s.rlike(f"^(?:{pattern})$"), F.struct(F.lit(k).alias("of"), F.lit(bits).alias("bits"))).otherwise(least)

    of = F.struct(least.alias("of"), windows(s).alias("w"))
    reached = bound(of, lambda x: F.when(x["of"]["of"] == NAMES, x["w"]["mixed"]).otherwise(x["w"]["entropy"]) >= x["of"]["bits"])
    return F.when((F.length(s) < WINDOW) | s.rlike(f"^{UUID}$"), F.lit(False)).otherwise(reached)


def _is_secret(s: Column) -> Column:
    t = F.when(s.rlike(PATH), F.regexp_replace(s, STEP, " ")).otherwise(s)
    for pattern in GAPS:
        t = F.regexp_replace(t, pattern, " ")
    return F.exists(F.split(t, " "), _piece_is_secret)


def scan(df: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """One row for each row: id, spans (array of struct kind, start, end; code points, end exclusive), and `keep`.

    Pattern spans are leftmost and do not overlap within a kind; kinds may overlap. Entropy spans are added where a
    piece of a candidate reaches the least entropy of its character class and the candidate overlaps no pattern span.
    Placeholders, runs of one character and a path's names only cut a candidate into pieces. Words joined by marks, and
    letters of both cases, also need changes of case as no name has them. Null and empty texts have no spans; ids may
    repeat or be null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    some = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    long_ = text.rlike(r"[A-Za-z0-9+/_-]{20}")  # all but assignments have 20 such characters in a row
    names = [id_col, *keep]
    s = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], text.alias("t"), some.alias("some"), long_.alias("long_"))
    at_least = lambda n: lambda hit: F.length(hit) >= n
    patterns = {
        "assign": (F.col("some"), ASSIGN, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_LEAST),
        "access": (F.col("long_") & F.col("t").contains("AKIA"), ACCESS, at_least(ACCESS_LEAST)),
        # runs of fewer characters are no matches to keep, and none starts within a run
        "hex": (F.col("long_"), HEX[:-1] + f"{{{HEX_LEAST},}}", at_least(HEX_LEAST)),
        "entropy": (F.col("long_"), CANDIDATE, _is_secret),
    }
    none = F.expr("cast(array() as array<string>)")
    found = {}
    for kind, (when, pattern, _) in patterns.items():
        found[f"{kind}_hits"] = F.when(when, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).otherwise(none)
        found[f"{kind}_gaps"] = F.when(when, F.split("t", pattern, -1)).otherwise(none)
    s = s.withColumns(found)
    s = s.withColumns({kind: _spans(F.col(f"{kind}_hits"), F.col(f"{kind}_gaps"), keeps) for kind, (_, _, keeps) in patterns.items()})
    tag = lambda i: lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("k"), x["end"].alias("end"))
    tagged = F.array_sort(F.concat(*[F.transform(k, tag(i)) for i, k in enumerate(KINDS)]))
    s = s.withColumn("tagged", F.when(F.col("some") | F.col("long_"), tagged).otherwise(F.expr("cast(array() as array<struct<start: int, k: int, end: int>>)")))
    # an entropy span stays where no pattern span before it ends beyond its start, and none after it starts before its end
    last, top = len(KINDS) - 1, 2**31 - 1
    before = running(F.transform("tagged", lambda x: F.when(x["k"] < last, x["end"]).otherwise(0)), 0, F.greatest)
    after = F.reverse(running(F.reverse(F.transform("tagged", lambda x: F.when(x["k"] < last, x["start"]).otherwise(top))), top, F.least))
    near = F.zip_with(F.concat(F.array(F.lit(0)), before), after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    clear = lambda x: (x["x"]["k"] < last) | ((x["near"]["before"] <= x["x"]["start"]) & (x["near"]["after"] >= x["x"]["end"]))
    kept = F.filter(F.zip_with("tagged", near, lambda x, n: F.struct(x.alias("x"), n.alias("near"))), lambda x: x["x"].isNotNull() & clear(x))
    kind = F.array(*map(F.lit, KINDS))
    spans = F.transform(kept, lambda x: F.struct(F.get(kind, x["x"]["k"]).alias("kind"), x["x"]["start"].alias("start"), x["x"]["end"].alias("end")))
    return s.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], spans.alias("spans"), F.col("t").alias("_text"))


def redact(df: DataFrame, id_col: str, text_col: str, keep: list[str] = ()) -> DataFrame:
    """id, `keep`, and the text with each span, overlapping ones merged, replaced by a mark with the kind of its first.

    Texts without a span stay as they are, null included.
    """
    found = scan(df, id_col, text_col, [*keep, text_col])
    reach = F.concat(F.array(F.lit(0)), running(F.transform("spans", lambda x: x["end"]), 0, F.greatest))
    pairs = F.filter(F.zip_with("spans", reach, lambda x, at: F.struct(x.alias("x"), at.alias("at"))), lambda p: p["x"].isNotNull())

    def piece(p: Column) -> Column:
        new = F.concat(F.col("_text").substr(p["at"] + 1, p["x"]["start"] - p["at"]), F.lit("["), p["x"]["kind"], F.lit("]"))
        return F.when(p["x"]["start"] < p["at"], F.lit("")).otherwise(new)

    rest = F.col("_text").substr(F.array_max(F.transform("spans", lambda x: x["end"])) + 1, F.length("_text"))
    new = F.concat(F.array_join(F.transform(pairs, piece), ""), rest)
    return found.withColumn(text_col, F.when(F.size("spans") > 0, new).otherwise(F.col(text_col))).drop("spans", "_text")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
