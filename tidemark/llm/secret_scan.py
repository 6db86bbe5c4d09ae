"""Secrets: fixed patterns, and further strings that pass a battery of randomness tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, let, match_spans

KINDS = ("assign", "access", "hex", "random")
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
}
VALUE = r"""[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$"""
LEAST_VALUE = 12
GATES = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{16}"}
#: Strings worth a test: 20 characters of the encodings below, with a digit and a letter among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
CANDIDATE_GATE = "[A-Za-z0-9+/_=-]{20}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, the narrowest first: what all characters are, and the alphabet.
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + LOWER[:6]), ("^[0-9A-F]+$", DIGITS + UPPER[:6]), ("^[A-Z2-7]+$", UPPER + DIGITS[2:8]), ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER), ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER), ("^[0-9A-Za-z+/]+$", DIGITS + UPPER + LOWER + "+/"), ("^[0-9A-Za-z_-]+$", DIGITS + UPPER + LOWER + "-_"),
)
#: Bits a string of its length and alphabet could hold; under that the tests could not tell.
LEAST_BITS = 80.0
#: Share of wrong ones allowed among the strings called not random, in each class of length.
FALSE_DISCOVERIES = 0.05
LENGTHS = (32, 64, 128)
STEPS_PER_DECADE, DECADES = 50, 30

SPANS = "array<struct<start:int,k:int,end:int>>"


def _kind_spans(text: Column, k: int) -> Column:
    kind = KINDS[k]
    found = match_spans(text, BASE[kind])
    if kind == "assign":
        found = F.filter(found, lambda m: F.length(F.regexp_extract(m["s"], VALUE, 1)) >= LEAST_VALUE)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))
    held = text.contains(GATES[kind]) if kind == "access" else text.rlike(GATES[kind])
    return F.when(held, spans).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """All base matches as ``start, k, end`` (k: position of the kind in KINDS), sorted."""
    return F.array_sort(F.concat(*[_kind_spans(text, k) for k in range(3)]))


def _beyond(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic approximation, within 0.0002)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(600.0))))


def _safe(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-30)), F.lit(1.0))


def randomness(s: Column) -> Column:
    """Struct ``n, bits, p`` of a string: its length, the bits it could hold and the p-value of being random.

    The narrowest encoding that fits gives the alphabet.  Tests: chi-squared against equal
    use of the alphabet (cube-root normal approximation), runs above and below its middle,
    and correlation of neighbours; Fisher's sum joins the three.
    """
    plain = F.regexp_replace(s, "=+$", "")
    alphabet = F.coalesce(*[F.when(plain.rlike(pattern), F.lit(letters)) for pattern, letters in ENCODINGS], F.lit(DIGITS + UPPER + LOWER + "+/-_"))

    def tests(v: Column, k: Column) -> Column:
        n = F.size(v).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
        sorted_v = F.array_sort(v)
        # sum of squared counts: each place adds twice the number of equal ones before it, plus one
        squares = let(sorted_v, lambda w: F.aggregate(w, F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum")), lambda a, x: let(
            F.when(x == a["last"], a["run"] + 1).otherwise(1), lambda run: F.struct(x.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))))["sum"])
        df = k - 1
        chi = F.greatest(squares * k / n - n, F.lit(0.0))
        p_chi = _beyond((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        high = F.transform(v, lambda x: (2 * x >= k).cast("int"))
        changes = let(high, lambda h: total(F.transform(h, lambda x, i: F.coalesce((x != F.get(h, i - 1)).cast("double"), F.lit(0.0)))))
        ups = let(high, lambda h: total(F.transform(h, lambda x: x.cast("double"))))

        def p_runs(u: Column) -> Column:
            mean = 2 * u * (n - u) / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(var > 0, 2 * _beyond(F.abs(changes + 1 - mean) / F.sqrt(var))).otherwise(F.lit(1e-30))

        mean = total(F.transform(v, lambda x: x.cast("double"))) / n

        def p_serial(m: Column) -> Column:
            var = total(F.transform(v, lambda x: (x - m) * (x - m)))
            cov = total(F.transform(v, lambda x, i: F.coalesce((x - m) * (F.get(v, i + 1) - m), F.lit(0.0))))
            return let(var, lambda q: F.when(q > 0, 2 * _beyond(F.abs(cov / q) * F.sqrt(n))).otherwise(F.lit(1e-30)))

        half = -(F.log(_safe(p_chi)) + F.log(_safe(let(ups, p_runs))) + F.log(_safe(let(mean, p_serial))))
        joined = let(half, lambda x: F.exp(-x) * (1 + x + x * x / 2))
        return F.struct(F.size(v).alias("n"), (n * F.log2(k)).alias("bits"), _safe(joined).alias("p"))

    return let(F.struct(plain.alias("s"), alphabet.alias("a")), lambda e: let(
        F.transform(F.sequence(F.lit(1), F.length(e["s"])), lambda i: F.call_function("instr", e["a"], F.substr(e["s"], i, F.lit(1))) - 1), lambda v: tests(v, F.length(e["a"]).cast("double"))))


def _length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i, limit in reversed(list(enumerate(LENGTHS))):
        out = F.when(n < limit, i).otherwise(out)
    return out


def limits(counts: dict[int, dict[int, int]]) -> dict[int, int]:
    """Per length class the least step of -log p at which strings are called not random (Benjamini-Hochberg on the steps' counts)."""
    out = {}
    for c, steps in counts.items():
        total, seen = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):  # from the smallest p up
            seen += steps[step]
            if 10 ** (-step / STEPS_PER_DECADE) <= FALSE_DISCOVERIES * seen / total:
                out[c] = step
    return out


def find(docs: DataFrame, columns: list[str], scratch: Scratch | None = None) -> DataFrame:
    """``columns`` of every row of ``docs`` with ``_base`` and ``_spans``: arrays of ``start, k, end`` in code points, sorted by start and kind.

    ``_spans`` holds the base matches and, as kind ``random``, other strings that look drawn
    at random.  Being random is the hypothesis that the tests try to reject; rejections are
    controlled in each class of length over all strings of the corpus, counted in fine steps
    of the p-value, and what is not rejected and long enough to be told is a secret.
    Strings that meet a base match are left to it.  Null text is empty; repeated rows each get theirs.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    gate = text.rlike(GATES["assign"]) | text.contains(GATES["access"]) | text.rlike(GATES["hex"]) | text.rlike(CANDIDATE_GATE)
    empty = F.array().cast(SPANS)
    quiet = docs.where(~gate).select(*columns, empty.alias("_base"), empty.alias("_spans"))
    rows = scratch.keep(docs.where(gate).select(*columns, base_spans(text).alias("_base"), match_spans(text, CANDIDATE).alias("_cands")).withColumn("rid", F.monotonically_increasing_id()), "rows")
    free = rows.select("rid", F.explode(F.filter("_cands", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))).alias("c"))
    tested = free.select("rid", F.col("c.start").alias("start"), F.col("c.end").alias("end"), randomness(F.col("c.s")).alias("t"))
    tested = scratch.keep(tested.select("rid", "start", "end", "t.*"), "tested").where(F.col("bits") >= LEAST_BITS)
    step = F.least(F.floor(-F.log10("p") * STEPS_PER_DECADE), F.lit(STEPS_PER_DECADE * DECADES)).cast("int")
    tested = tested.withColumn("class", _length_class(F.col("n"))).withColumn("step", step)
    counts: dict[int, dict[int, int]] = {}
    for r in tested.groupBy("class", "step").count().collect():  # classes x steps at most
        counts.setdefault(r["class"], {})[r["step"]] = r["count"]
    rejected = F.lit(False)
    for c, least in limits(counts).items():
        rejected = rejected | (F.col("class") == c) & (F.col("step") >= least)
    added = tested.where(~rejected).groupBy("rid").agg(F.collect_list(F.struct("start", F.lit(3).alias("k"), "end")).alias("_more"))
    loud = rows.join(added, "rid", "left").withColumn("_spans", F.array_sort(F.concat("_base", F.coalesce("_more", empty))))
    return loud.select(*columns, "_base", "_spans").unionByName(quiet)


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in order."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")
