"""Operator 4: secrets by patterns and by a battery of randomness tests (built-in functions only).

Matches are marked in place with a sign no pattern uses and the text is split at the
marks, so lengths of the parts give positions in code points.  Beside the base kinds,
runs of key-like characters are candidates: their encoding is inferred (hexadecimal,
base 32, base 64), and chi-squared uniformity over the encoding's alphabet, a runs test
about the alphabet's middle and the lag-one serial correlation are combined into one
p-value of randomness.  These p-values go through Benjamini-Hochberg over the whole corpus
within length classes: a candidate whose randomness is rejected is ordinary text.  Since a
short run may be ordinary and yet not be rejected, what is left also has to show few equal
pairs of symbols against ordinary text, and those p-values are controlled in the same way.
A random run that touches a base span adds nothing.

Defined cases: null text counts as empty and has no spans; characters equal to the mark
are read as another control character; very long texts are scanned whole, the work growing
with the number of matches; null and repeated ids are rows like any other, scanned one by
one; candidates of equal p-value share one verdict; an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize

MARK = "\u0001"
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of fewer characters than asked for fails at each of its later starts too.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.12),
    ("base32", r"^[A-Z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 0.09),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065),
)
#: Upper ends of the length classes within which false discoveries are controlled.
LENGTH_CLASSES = (24, 32, 48)
_SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def _bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often lambdas inside ``f`` look into it."""
    return F.get(F.transform(F.array(x), f), 0)


def _matches(text: Column, pattern: str, kind: int, chunk: int = 64) -> Column:
    """Array of (start, kind, end, match) of all matches, left to right.

    Positions are sums of the lengths of the parts before: whole chunks of parts first, then
    the rest of the own chunk, so that no match adds up all parts before it.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def spans(ps: Column, ls: Column, starts: Column) -> Column:
        def span(j: Column) -> Column:
            i = 2 * j + 1
            c = F.floor(i / chunk).cast("int")
            start = F.get(starts, c) + total(F.slice(ls, c * chunk + 1, i - c * chunk))
            return F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + F.get(ls, i)).alias("e"), F.get(ps, i).alias("m"))

        return F.transform(F.sequence(F.lit(0), F.floor(F.size(ps) / 2).cast("int") - 1), span)

    def placed(ps: Column, ls: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / chunk).cast("int"))
        sums = F.transform(chunks, lambda c: total(F.slice(ls, c * chunk + 1, chunk)))
        return _bound(sums, lambda ts: _bound(F.transform(ts, lambda _, c: total(F.slice(ts, F.lit(1), c))), lambda starts: spans(ps, ls, starts)))

    found = _bound(parts, lambda ps: _bound(F.transform(ps, F.length), lambda ls: placed(ps, ls)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _lower_tail(z: Column) -> Column:
    """Normal distribution function, by its logistic approximation."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-600.0), -(1.5976 * z + 0.07056 * z * z * z))))


def _tests(match: Column) -> Column:
    """Randomness and text p-values of one candidate under its inferred encoding."""
    body = F.rtrim(match, F.lit("="))
    name, size, alphabet, pairs, symbols = F.lit("base64"), F.lit(64), F.lit(ALPHABETS[2][2]), F.lit(ALPHABETS[2][3]), F.translate(body, "-_", "+/")
    for kind, pattern, letters, chance in ALPHABETS[1::-1]:
        is_kind = match.rlike(pattern)
        name, size, alphabet, pairs = (F.when(is_kind, F.lit(a)).otherwise(b) for a, b in ((kind, name), (len(letters), size), (letters, alphabet), (chance, pairs)))
        symbols = F.when(is_kind, F.lower(body)).otherwise(symbols)
    x = F.transform(F.filter(F.split(symbols, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c))
    return F.struct(name.alias("encoding"), size.alias("size"), pairs.alias("pairs"), x.alias("x"))


def _extend(c: Column, names: list[str], **more: Column) -> Column:
    return F.struct(*[c[n].alias(n) for n in names], *[v.alias(k) for k, v in more.items()])


def _p_values(candidates: Column) -> Column:
    """p_random and p_text of each candidate; each step reads only finished fields, so the work stays linear."""
    names = ["s", "e", "size", "pairs", "x"]
    out = F.transform(candidates, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), *[c["t"][k].alias(k) for k in names[2:]]))
    out = F.transform(
        out,
        lambda c: _extend(
            c, names, n=F.size(c["x"]).cast("double"),
            same=F.aggregate(F.sequence(F.lit(1), c["size"]), F.lit(0.0), lambda a, s: a + F.pow(F.size(F.filter(c["x"], lambda y: y == s)).cast("double"), 2)),
            total=F.aggregate(c["x"], F.lit(0.0), lambda a, y: a + y),
            high=F.size(F.filter(c["x"], lambda y: y > c["size"] / 2)).cast("double"),
        ),
    )
    names += ["n", "same", "total", "high"]
    steps = lambda c: F.sequence(F.lit(1), F.size(c["x"]) - 1)
    out = F.transform(
        out,
        lambda c: _extend(
            c, names[:2] + names[2:4] + names[5:],
            var=F.aggregate(c["x"], F.lit(0.0), lambda a, y: a + F.pow(y - c["total"] / c["n"], 2)),
            lag=F.aggregate(steps(c), F.lit(0.0), lambda a, i: a + (F.get(c["x"], i) - c["total"] / c["n"]) * (F.get(c["x"], i - 1) - c["total"] / c["n"])),
            runs=F.aggregate(steps(c), F.lit(1.0), lambda a, i: a + ((F.get(c["x"], i) > c["size"] / 2) != (F.get(c["x"], i - 1) > c["size"] / 2)).cast("double")),
        ),
    )
    return F.transform(out, _combined)


def _combined(c: Column) -> Column:
    size, n, n1 = c["size"].cast("double"), c["n"], c["high"]
    n2 = n - n1
    z_chi = (size / n * c["same"] - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
    both = 2 * n1 * n2
    z_runs = F.when((n1 < 2) | (n2 < 2), F.lit(6.0)).otherwise((c["runs"] - both / n - 1) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9))))
    z_lag = F.when(c["var"] > 0, (c["lag"] / c["var"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(6.0))
    # Three squared normal scores: chi-squared with 3 degrees of freedom, by its cube-root approximation.
    total = F.pow(F.greatest(z_chi, F.lit(0.0)), 2) + F.pow(z_runs, 2) + F.pow(z_lag, 2)
    p_random = _lower_tail(-((F.cbrt(total / 3) - (1 - 2 / 27)) / math.sqrt(2 / 27)))
    # Equal pairs of symbols: ordinary text has more of them than random strings.
    p_text = _lower_tail(2 * (F.sqrt((c["same"] - n) / 2 + 1) - F.sqrt(c["pairs"] * n * (n - 1) / 2)))
    return F.struct(c["s"].alias("s"), c["e"].alias("e"), _length_class(c["e"] - c["s"]).alias("klass"), p_random.alias("p_random"), p_text.alias("p_text"))


def _length_class(n: Column) -> Column:
    return sum((F.when(n > x, 1).otherwise(0) for x in LENGTH_CLASSES), F.lit(0))


def _cuts(tested: DataFrame, p: str, rate: float) -> dict[int, float]:
    """Benjamini-Hochberg cut of each length class for the column ``p`` of tested(klass, ..), from counts in fine bins of p.

    At most 2000 bins a class reach the window, whatever the corpus.
    """
    fine = 40
    bins = tested.select("klass", F.least(F.lit(1999), F.floor(-F.log(F.greatest(F.col(p), F.lit(1e-30))) * fine)).cast("int").alias("bin"))
    bins = bins.groupBy("klass", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("klass")
    ranked = bins.withColumn("rank", F.sum("n").over(w.orderBy(F.desc("bin")))).withColumn("m", F.sum("n").over(w))
    # The largest p of a bin against its rank: never more discoveries than the exact procedure allows.
    top = F.exp(-F.col("bin") / fine)
    good = ranked.where(top <= rate * F.col("rank") / F.col("m"))
    return {r["klass"]: r["cut"] for r in good.groupBy("klass").agg(F.max(top).alias("cut")).collect()}


def scan_secrets(documents: DataFrame, false_discovery_rate: float = 0.02) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for every whole text."""
    text = F.coalesce("text", F.lit(""))
    text = F.when(text.contains(MARK), F.replace(text, F.lit(MARK), F.lit("\u0002"))).otherwise(text)
    found = documents.select("doc_id", text.alias("t")).select(
        "doc_id",
        F.filter(_matches(F.col("t"), ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN_VALUE, 1)) >= 8).alias("assign"),
        F.when(F.col("t").contains("AKIA"), _matches(F.col("t"), ACCESS, 1)).otherwise(F.array().cast(_SPAN)).alias("access"),
        _matches(F.col("t"), HEX, 2).alias("hex"),
        _matches(F.col("t"), CANDIDATE, 3).alias("random"),
    )
    base = F.array_sort(F.transform(F.concat("assign", "access", "hex"), lambda s: F.struct(s["s"].alias("s"), s["k"].alias("k"), s["e"].alias("e"))))
    found = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base"), "random")
    free = F.filter("random", lambda c: ~F.exists("base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    tested = F.transform(free, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), _tests(c["m"]).alias("t")))
    found = found.withColumn("candidates", _p_values(tested)).drop("random")
    scanned = materialize(found, "secrets")
    tested = scanned.select(F.explode("candidates").alias("c")).select("c.*")
    ordinary = _cuts(tested, "p_random", false_discovery_rate)
    random = lambda c: c["p_random"] > _cut(c["klass"], ordinary)
    unlike = _cuts(tested.where(F.col("p_random") > _cut(F.col("klass"), ordinary)), "p_text", false_discovery_rate)
    passed = F.filter("candidates", lambda c: random(c) & (c["p_text"] <= _cut(c["klass"], unlike)))
    added = F.transform(passed, lambda c: F.struct(c["s"].alias("s"), F.lit(3).alias("k"), c["e"].alias("e")))
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", added))).alias("spans"),
    )


def _cut(klass: Column, cuts: dict[int, float]) -> Column:
    out = F.lit(-1.0)
    for k, v in cuts.items():
        out = F.when(klass == k, F.lit(v)).otherwise(out)
    return out


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))), ",")
