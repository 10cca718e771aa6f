"""Operator 9: secret scans (DataFrame functions only).

Patterns of known kinds give the base spans. The method adds spans of kind ``random``: long unbroken runs
of token characters that look random. Each run's encoding is inferred (decimal, hexadecimal, base 32, letters
of one case and digits, base 62, base 64), and a battery tests it against uniform randomness over that
alphabet: chi-squared of the character counts, runs above and below the middle of the alphabet, and the
serial correlation of neighbours. The three p-values combine by Bonferroni. Runs that are random are those
whose randomness isn't rejected; the rejections are controlled by Benjamini-Hochberg at a level ``FDR``
within each class of lengths (all texts together), and runs too short for the tests to tell words from
random characters (an expected chi-squared deviation too small) are never added.

Defined cases: a null or empty text has no spans; spans count code points, end exclusive; base spans stay
whatever the battery says, and a random span that overlaps a base span isn't added; repeated rows are
scanned one by one; other columns pass through ``scan`` and ``redact``, those named like an output column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: The kinds in their listed order and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
FDR = 0.01
OUTPUTS = ("spans",)


def _found(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches: the pieces between matches and the matches themselves,
    laid end to end, give the positions."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else hits
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("rank"), end.alias("end"), x["value"].alias("value")))
        keep = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(pattern), F.aggregate(rows, state, step)["spans"]).otherwise(empty)


def base_spans(text: Column) -> Column:
    return F.concat(_found(text, ASSIGN, 0, 6), _found(text, ACCESS, 1), _found(text, HEX, 2))


def _p_two_sided(z: Column) -> Column:
    """2 * (1 - normal distribution(|z|)) by a rational approximation, good to 1e-7."""
    x = F.abs(z) / 2 ** 0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def alphabet(value: Column) -> Column:
    """(name, characters in order) of the narrowest encoding that has all characters of a run."""
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    known = (("decimal", "[0-9]+", digits), ("hex", "[0-9a-f]+", digits + "abcdef"), ("hex", "[0-9A-F]+", digits + "ABCDEF"),
             ("base32", "[A-Z2-7]+=*", upper + "234567"), ("letters", "[a-z]+", lower), ("letters", "[A-Z]+", upper),
             ("base36", "[a-z0-9]+", lower + digits), ("base36", "[A-Z0-9]+", upper + digits), ("letters", "[A-Za-z]+", upper + lower),
             ("base62", "[A-Za-z0-9]+", upper + lower + digits))
    out = None
    for name, pattern, chars in known:
        one = F.struct(F.lit(name).alias("name"), F.lit(chars).alias("chars"))
        out = F.when(value.rlike(f"^{pattern}$"), one) if out is None else out.when(value.rlike(f"^{pattern}$"), one)
    url = value.rlike("[-_]")
    return out.otherwise(F.struct(F.when(url, "base64url").otherwise("base64").alias("name"),
                                  F.when(url, upper + lower + digits + "-_").otherwise(upper + lower + digits + "+/").alias("chars")))


def battery(runs: DataFrame) -> DataFrame:
    """``runs`` (value) with the encoding and the combined p-value of the three tests."""
    body = F.regexp_replace("value", "=+$", "")
    df = (runs.withColumn("encoding", alphabet(F.col("value"))).withColumn("codes", F.transform(
        F.split(body, ""), lambda c: F.instr(F.col("encoding.chars"), c) - 1)))
    df = df.withColumn("codes", F.filter("codes", lambda c: c >= 0)).withColumn("n", F.size("codes").cast("double"))
    k = F.length("encoding.chars").cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    counts = F.transform(F.array_distinct("codes"), lambda c: F.size(F.filter("codes", lambda d: d == c)).cast("double"))
    df = df.withColumn("k", k).withColumn("squares", total(F.transform(counts, lambda c: c * c)))
    chi = F.col("squares") * F.col("k") / F.col("n") - F.col("n")
    free = F.col("k") - 1
    # the upper tail by the cube root, as half of the two-sided value where it deviates upwards
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    df = df.withColumn("p_chi", F.when(z > 0, _p_two_sided(z) / 2).otherwise(1 - _p_two_sided(z) / 2))
    high = F.transform("codes", lambda c: (c * 2 >= F.col("k") - 1).cast("int"))
    pairs = lambda xs: F.zip_with(F.slice(xs, 1, F.size(xs) - 1), F.slice(xs, 2, F.size(xs) - 1), lambda a, b: F.struct(
        a.alias("a"), b.alias("b")))
    df = df.withColumn("high", high).withColumn("n1", total(F.transform("high", lambda x: x.cast("double"))))
    df = df.withColumn("n0", F.col("n") - F.col("n1")).withColumn(
        "changes", F.size(F.filter(pairs(F.col("high")), lambda x: x["a"] != x["b"])) + F.lit(1.0))
    both = 2 * F.col("n0") * F.col("n1")
    mean = both / F.col("n") + 1
    var = both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    df = df.withColumn("p_runs", F.when(var > 0, _p_two_sided((F.col("changes") - mean) / F.sqrt(var))).otherwise(F.lit(0.0)))
    mid = (F.col("k") - 1) / 2
    products = total(F.transform(pairs(F.col("codes")), lambda x: (x["a"] - mid) * (x["b"] - mid)))
    spread = (F.col("k") * F.col("k") - 1) / 12
    df = df.withColumn("p_serial", _p_two_sided(products / (spread * F.sqrt(F.col("n") - 1))))
    p = F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial"))
    return df.withColumn("p", p).drop("codes", "high", "n0", "n1", "changes", "squares", "p_chi", "p_runs", "p_serial")


#: Lower ends of the classes of lengths.
CLASSES = (20, 28, 40, 64, 128, 512)


def random_runs(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """Runs whose randomness stands. The Benjamini-Hochberg border of a class comes from a histogram of
    p-values (500 steps on a logarithmic scale), a table of fixed size. A run must be long enough that words
    (about eleven equally likely letters) would be expected to fail: n * (k / 11 - 1) well above the spread."""
    size = F.length("value")
    level = F.lit(0)
    for i, least in enumerate(CLASSES):
        level = F.when(size >= least, i).otherwise(level)
    step = F.least(F.lit(499), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-50))) * 10)).cast("int")
    df = saved(tested.withColumn("level", level).withColumn("step", step))
    steps = df.groupBy("level", "step").agg(F.count("*").alias("n"))
    down = Window.partitionBy("level").orderBy(F.desc("step"))
    whole = Window.partitionBy("level")
    steps = steps.withColumn("seen", F.sum("n").over(down)).withColumn("all", F.sum("n").over(whole))
    border = steps.filter(F.pow(F.lit(10.0), -F.col("step") / 10) <= fdr * F.col("seen") / F.col("all")).groupBy("level").agg(
        F.min("step").alias("border"))
    power = F.col("n") * (F.col("k") / 11 - 1) / F.sqrt(2 * (F.col("k") - 1))
    mixed = F.col("value").rlike("[0-9]") & (F.col("value").rlike("[A-Z]") | F.col("value").rlike("[a-z]"))
    return (df.join(F.broadcast(border), "level", "left").filter(F.col("border").isNull() | (F.col("step") < F.col("border")))
            .filter((power >= 3) & mixed).drop("level", "step", "border"))


def scan(df: DataFrame, fdr: float = FDR) -> DataFrame:
    """``df`` (doc_id, text, ...) with ``spans``: array of (start, rank of the kind, end), in order."""
    docs = df.drop(*OUTPUTS)
    text = F.coalesce(F.col("text"), F.lit(""))
    # the few texts with a hit carry their spans; each row has an id of its own for the way back
    marked = docs.withColumn("base", base_spans(text)).withColumn("runs", _found(text, RUN, 3))
    hits = saved(marked.filter("size(base) > 0 or size(runs) > 0").select(
        "doc_id", F.crc32(text).alias("crc"), F.transform("base", lambda s: F.struct(s["start"], s["rank"], s["end"])).alias(
            "base"), "runs"), "zstd").dropDuplicates(["doc_id", "crc"])
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    runs = hits.select("doc_id", "crc", F.explode(free).alias("r")).select("doc_id", "crc", "r.start", "r.end", "r.value")
    added = random_runs(battery(runs), fdr).groupBy("doc_id", "crc").agg(
        F.collect_list(F.struct("start", F.lit(3).alias("rank"), "end")).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,end:int>>"))))
    own = hits["doc_id"].eqNullSafe(added["doc_id"]) & (hits["crc"] == added["crc"])  # also where the doc_id is null
    spans = hits.join(added, own, "left").select(hits["doc_id"], hits["crc"], spans.alias("spans")).filter("size(spans) > 0")
    same = (docs["doc_id"].eqNullSafe(spans["doc_id"])) & (F.crc32(F.coalesce(docs["text"], F.lit(""))) == spans["crc"])
    return docs.join(spans, same, "left").select(*(docs[c] for c in docs.columns), F.coalesce(
        spans["spans"], F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("spans"))


def named(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def redact(df: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark`` (overlapping spans by one); a null text stays null."""
    scanned = scan(df)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc, s):
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, F.concat(acc["text"], gap, F.lit(mark))).otherwise(
            acc["text"]).alias("text"))

    done = F.aggregate("spans", state, step)
    text = F.when(F.size("spans") > 0, F.concat(done["text"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))).otherwise(
        F.col("text"))
    return scanned.withColumn("text", text).drop("spans")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    return docs.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


QUERIES = {"op9_secrets": op9_secrets}
ORACLES: dict[str, str] = {}
