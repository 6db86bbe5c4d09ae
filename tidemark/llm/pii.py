"""Personal data: fixed patterns, and further spans that boosted trees accept among many candidates."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, let, match_spans, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Loops are possessive and runs are entered at their start (or where the last
#: match ended), which gives the same matches in linear time on very long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What a text must hold to have a match of the kind at all.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: High-recall candidates: written-out addresses, digit groups, hexadecimal groups with colons.
CANDIDATES = {
    "text": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9._%+-]++){0,3}+(?:@|\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "digits": r"(?<![0-9A-Za-z])\+?\(?[0-9][0-9\x20().:/-]{5,}[0-9](?![0-9A-Za-z])",
    "colons": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
CANDIDATE_GATES = {"text": r"@|[(\[]at[)\]]|\x20at\x20[^\x20]+(?:\x20dot\x20|\x20?[(\[]dot[)\]])", "digits": r"[0-9][0-9\x20().:/-]{5}", "colons": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"}
#: Written-out addresses: what stands for the signs, and what an address looks like with them; all eight groups of an IPv6 address.
AT, DOT = r"\x20?(?:\(at\)|\[at\])\x20?|\x20at\x20", r"\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20"
ADDRESS = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$"
IPV6 = r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"
#: Words before a span that name what it is.
CONTEXT = r"(?i)(?:mail|phone|tel|call|fax|mobile|card|visa|account|iban|addr|contact|ssn|\bip\b)"
BEFORE = 24

FEATURES = ("len", "digits", "runs", "longest", "shortest", "letters", "blanks", "dashes", "dots", "colons", "parens", "at", "context", "in_word", "letter_after", "quote_before", "is_text", "is_colons")
FIELDS = [f"f_{f}" for f in FEATURES]
#: Share of accepted candidates that must be right on the part not fitted on.
PRECISION = 0.95
#: Accepted candidates needed to set a threshold at all.
ENOUGH = 20
TREES, DEPTH = 8, 3

SPANS = "array<struct<start:int,k:int,end:int>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return let(_digits(s), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _holds(text: Column, gate: str) -> Column:
    return text.contains(gate) if gate == "@" else text.rlike(gate)


def _kind_spans(text: Column, k: int) -> Column:
    kind = KINDS[k]
    good = F.filter(match_spans(text, BASE[kind]), lambda m: _valid(kind, m["s"]))
    spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end")))
    return F.when(_holds(text, GATES[kind]), spans).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    """All valid base matches as ``start, k, end`` (k: position of the kind in KINDS), sorted."""
    return F.array_sort(F.concat(*[_kind_spans(text, k) for k in range(len(KINDS))]))


def _candidates(text: Column) -> Column:
    """Overlapping candidate spans of all generators with the text around them."""
    def spans(by: str) -> Column:
        def around(m: Column) -> Column:
            begin = F.greatest(m["start"] - BEFORE, F.lit(0))
            return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["s"].alias("s"), F.lit(by).alias("by"),
                            F.substr(text, begin + 1, m["start"] - begin).alias("before"), F.substr(text, m["end"] + 1, F.lit(1)).alias("after"))

        return F.when(text.rlike(CANDIDATE_GATES[by]), F.transform(match_spans(text, CANDIDATES[by]), around)).otherwise(empty)

    empty = F.array().cast("array<struct<start:int,end:int,s:string,by:string,before:string,after:string>>")
    return F.concat(*[spans(by) for by in CANDIDATES])


def _described(cands: DataFrame) -> DataFrame:
    """Format and context of a candidate (``c``) as numbers; neither the plus sign nor a checksum, which the base rules already use."""
    s = F.regexp_replace("c.s", r"^\+", "")
    runs = F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))
    n = lambda pattern: F.length(s) - F.length(F.regexp_replace(s, pattern, ""))
    sizes = let(runs, lambda r: F.transform(r, lambda x: F.length(x)))
    made = {
        "len": F.length(s), "digits": n("[0-9]"), "runs": F.size(runs), "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "letters": n("[A-Za-z]"), "blanks": n(" "), "dashes": n("-"), "dots": n(r"\."), "colons": n(":"), "parens": n("[()]"), "at": n("@"),
        "context": F.col("c.before").rlike(CONTEXT).cast("int"), "in_word": F.col("c.before").rlike("[A-Za-z0-9]$").cast("int"), "letter_after": F.col("c.after").rlike("[A-Za-z0-9]").cast("int"),
        "quote_before": F.col("c.before").rlike("[\"'=]$").cast("int"), "is_text": (F.col("c.by") == "text").cast("int"), "is_colons": (F.col("c.by") == "colons").cast("int"),
    }
    named = cands.select("*", *[F.coalesce(made[f].cast("double"), F.lit(0.0)).alias(f"f_{f}") for f in FEATURES])
    kind = F.when(F.col("c.by") == "text", 0).when((F.col("c.by") == "colons") | (F.col("f_dots") == 3) & (F.col("f_runs") == 4), 1).when(F.col("f_digits") >= 14, 2).otherwise(3)
    return named.withColumn("k", kind)


def _accepted(rows: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``rid, start, k, end`` of the candidates that the fitted trees accept; None if there is nothing to fit on."""
    cands = _described(rows.select("rid", "_base", F.explode("_cands").alias("c")))
    touches = F.exists("_base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    whole = F.exists("_base", lambda b: (b["start"] >= F.col("c.start")) & (b["end"] <= F.col("c.end")) & (2 * (b["end"] - b["start"]) > F.col("c.end") - F.col("c.start")))
    signs = F.regexp_replace(F.regexp_replace("c.s", AT, "@"), DOT, ".")
    spelt = (F.col("c.by") == "text") & signs.rlike(ADDRESS) | (F.col("c.by") == "colons") & F.col("c.s").rlike(IPV6)
    right = whole | spelt & ~touches
    cands = scratch.keep(cands.select("rid", F.xxhash64("c.s", "c.before", "c.start").alias("key"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), "k", touches.alias("base"), right.cast("double").alias("label"), *FIELDS), "candidates")
    # equal candidates are one row with their number as weight: every candidate counts, and the same one lies on one half
    shapes = cands.withColumn("part", F.pmod("key", F.lit(2))).groupBy("part", "k", "label", *FIELDS).agg(F.count("*").cast("double").alias("n"))
    shapes = scratch.keep(shapes, "shapes")
    sides = {(r.part, r.label) for r in shapes.select("part", "label").distinct().collect()}
    if not {(0, 0.0), (0, 1.0)} <= sides:
        return None
    vectors = VectorAssembler(inputCols=FIELDS, outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False, weightCol="n").fit(vectors.transform(shapes.where("part = 0")).select("features", "label", "n"))
    score = lambda df: trees.transform(vectors.transform(df)).withColumn("p", F.round(vector_to_array("probability")[1], 4))
    levels = score(shapes.where("part = 1")).groupBy("k", "p").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("right")).collect()  # 10,001 rows a kind at most: p has four digits
    limits = {}
    for k in range(len(KINDS)):
        n = right = 0.0
        for r in sorted((r for r in levels if r.k == k), key=lambda r: -r.p):
            n, right = n + r.n, right + r.right
            if right >= ENOUGH and right >= PRECISION * n:
                limits[k] = r.p
    if not limits:
        return None
    passed = F.coalesce(*[F.when((F.col("k") == k) & (F.col("p") >= p), F.lit(True)) for k, p in limits.items()], F.lit(False))
    return score(cands.where("NOT base")).where(passed).select("rid", "start", "k", "end")


def find(docs: DataFrame, columns: list[str], scratch: Scratch | None = None) -> DataFrame:
    """``columns`` of every row of ``docs`` with ``_base`` and ``_spans``: arrays of ``start, k, end`` in code points, sorted by start and kind.

    ``_base`` holds the fixed patterns' valid matches; ``_spans`` those and the candidates,
    free of any base span, whose score reaches the threshold of their kind.  The trees learn
    from half of all candidates, equal ones as one row with a weight: one that mostly consists of a base span is
    personal, and so are a written-out address that is one with its signs put in and the
    eight groups of an IPv6 address; others are not; format and surroundings are shown to them, the plus sign and
    the checksum are not, so that spans of the same shape without those can be accepted.
    Thresholds come from all of the half not fitted on.  With too few examples
    nothing is added.  Null text is empty and has no spans; repeated rows each get theirs.
    """
    return _found(docs, columns, scratch).select(*unpacked(columns), "_base", "_spans")


def _found(docs: DataFrame, columns: list[str], scratch: Scratch | None) -> DataFrame:
    """``_row`` (``columns`` of ``docs``) with ``_base`` and ``_spans``."""
    scratch = scratch or Scratch(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    text = F.coalesce("text", F.lit(""))
    gate = F.lit(False)
    for g in (*GATES.values(), *CANDIDATE_GATES.values()):
        gate = gate | _holds(text, g)
    quiet = docs.where(~gate).select(row, F.array().cast(SPANS).alias("_base"), F.array().cast(SPANS).alias("_spans"))
    rows = scratch.keep(docs.where(gate).select(row, base_spans(text).alias("_base"), _candidates(text).alias("_cands")).withColumn("rid", F.monotonically_increasing_id()), "rows")
    more = _accepted(rows, scratch)
    if more is None:
        loud = rows.withColumn("_spans", F.col("_base"))
    else:
        added = more.groupBy("rid").agg(F.collect_set(F.struct("start", "k", "end")).alias("_more"))
        loud = rows.join(added, "rid", "left").withColumn("_spans", F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast(SPANS)))))
    return loud.select("_row", "_base", "_spans").unionByName(quiet)


def written(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in order."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; overlapping spans become one. Other texts stay as they are."""
    found = _found(docs, docs.columns, scratch)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        done = F.aggregate(spans, start, lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["k"])).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))))
        return let(done, lambda d: F.concat(d["out"], F.substr(text, d["at"] + 1, F.length(text))))

    text = F.col("_row.text")
    clean = F.when(F.size("_spans") > 0, cut(text, F.col("_spans"))).otherwise(text).alias("text")
    return found.select(*[clean if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
