"""Secret scans: known patterns and a randomness test battery.

``scan`` finds the base kinds (assign, access, hex) by pattern and adds spans of
kind ``random``: runs of an encoding's characters that do not look written. Each
candidate's encoding is inferred (hex, base32, base36, base62, base64), which gives its alphabet, and
three tests measure its departure from random characters: chi-squared
uniformity over the alphabet (by the exact mean and variance of the statistic,
as the counts are small), Wald-Wolfowitz runs about the alphabet's middle, and
lag-1 serial correlation. Fisher's method joins their p-values. Short and long
candidates have different power, so within each length class the
Benjamini-Hochberg rule at level ``Q``, over the candidates of all documents,
says which depart from randomness and are dropped.

That bounds keys dropped wrongly. What bounds false reports is the other null: that a candidate is written
(a name, a path). Its e-value is the likelihood of random characters of its encoding over that
under a Markov chain of written characters (``_written``), whose mean is 1 under that null; a candidate that the battery
drops has 0. The e-value form of the Benjamini-Hochberg rule at level ``FALSE_REPORTS``, within each
length class, says which are reported: it holds however candidates depend on each other, copies of one name too.

Everything is DataFrame functions in one scan of the texts. The corpus-wide rules need two
histograms, of p-values and of e-values, of at most ``len(LENGTHS) * (BINS + 2)`` rows each, whatever
the input.

Every step costs no more than in proportion to a token's length (times the alphabet's), so one
token of megabytes is no special case.

Spans are code points, end exclusive, of the whole match. Defined cases: a null
text is empty and has no spans; rows that repeat are scanned alike, and count as
often in the histogram; an empty table gives an empty table; input columns with the names of results are
replaced.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Candidates of the battery: runs of these characters with a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Lower ends of the length classes; false-discovery levels of drops and of reports; bins of a quarter power of two.
LENGTHS, Q, FALSE_REPORTS, BINS = (20, 24, 32, 48, 64), 0.01, 0.02, 400

#: Fixed values of the written null: shares of letters in English in percent, and how often lower case, upper case, a digit
#: or a sign follows each of them, or starts; how often a vowel follows a vowel, a consonant, or no letter.
LETTER_SHARES = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.2, "k": 0.8, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.1, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 1.0, "w": 2.4, "x": 0.2, "y": 2.0, "z": 0.1,
}
FOLLOWS = {"lower": (0.84, 0.08, 0.02, 0.06), "upper": (0.70, 0.24, 0.02, 0.04), "digit": (0.15, 0.10, 0.55, 0.20), "sign": (0.75, 0.12, 0.11, 0.02), "start": (0.60, 0.25, 0.10, 0.05)}
VOWEL_AFTER = {"vowel": 0.18, "consonant": 0.52, "none": 0.35}
SIGN_SHARES = {"/": 0.3, "_": 0.3, "-": 0.3, "+": 0.1}
VOWELS = "aeiou"

_BLOCK = 256
_ENCODINGS = (  # pattern of the token without padding, alphabet, how the token is read
    ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", "lower(x.s)"),
    ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "x.s"),
    ("^([0-9a-z]+|[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", "lower(x.s)"),
    ("^[0-9a-zA-Z]+$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "x.s"),
    ("^.*$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/", "translate(x.s, '-_', '+/')"),
)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(df: DataFrame, name: str, pattern: str, least: str) -> DataFrame:
    """Add array ``name`` of (start, stop, s) of all leftmost non-overlapping
    matches for which ``least`` (SQL over x) holds. The gaps between matches give
    the places; running sums go by blocks, so many matches in one text cost
    no more than in proportion."""
    p, found = _sql(pattern), f"__f_{name}"
    df = df.withColumn(found, F.expr(f"__text rlike {p}"))
    df = df.withColumns(
        {
            f"__m_{name}": F.expr(f"if({found}, regexp_extract_all(__text, {p}, 0), cast(array() as array<string>))"),
            f"__g_{name}": F.expr(f"if({found}, split(__text, {p}, -1), cast(array() as array<string>))"),
        }
    )
    m, g, s = f"__m_{name}", f"__g_{name}", f"__s_{name}"
    df = df.withColumn(s, F.expr(f"zip_with(slice({g}, 1, size({m})), {m}, (a, b) -> length(a) + length(b))"))
    df = df.withColumn(
        f"__b_{name}",
        F.expr(
            f"if(size({s}) = 0, array(0), aggregate(transform(sequence(0, (size({s}) - 1) div {_BLOCK}), b -> aggregate(slice({s}, int(b * {_BLOCK} + 1), {_BLOCK}), 0, (t, v) -> t + v)), array(0), (t, v) -> concat(t, array(element_at(t, -1) + v))))"
        ),
    )
    at = f"get(__b_{name}, int(i div {_BLOCK})) + aggregate(slice({s}, int((i div {_BLOCK}) * {_BLOCK} + 1), i % {_BLOCK} + 1), 0, (t, v) -> t + v)"
    spans = f"filter(transform({m}, (v, i) -> struct({at} - length(v) as start, {at} as stop, v as s)), x -> {least})"
    return df.withColumn(name, F.expr(spans)).drop(found, m, g, s, f"__b_{name}")


def _normal_tail(z: str) -> str:
    """SQL for the log of the two-sided tail of |z|, by a rational approximation of erfc."""
    poly = "aggregate(array(1.061405429D, -1.453152027D, 1.421413741D, -0.284496736D, 0.254829592D), 0D, (a, c) -> (a + c) / (1 + 0.3275911D * abs({z}) / sqrt(2D)))"
    return f"greatest(-690D, least(0D, ln({poly.format(z=z)}) - {z} * {z} / 2))"


def _states() -> tuple[str, str]:
    """Characters of candidates and their states: 0 and 1 a small vowel and consonant, 2 and 3 a large one, 4 a digit, 5 a sign."""
    small = "".join(LETTER_SHARES)
    of = ["01"[c not in VOWELS] for c in small]
    return small + small.upper() + "0123456789" + "".join(SIGN_SHARES), "".join([*of, *(str(int(x) + 2) for x in of), "4" * 10, "5" * len(SIGN_SHARES)])


def _steps(folded: bool) -> list[float]:
    """Log probabilities of state b after state a at 6 * a + b, and after the start at 36 + b. ``folded``: case is not told apart."""
    out = []
    for kind, vowel in (("lower", "vowel"), ("lower", "consonant"), ("upper", "vowel"), ("upper", "consonant"), ("digit", "none"), ("sign", "none"), ("start", "none")):
        lower, upper, digit, sign = FOLLOWS[kind]
        lower, upper = (lower + upper, 1e-300) if folded else (lower, upper)
        v = VOWEL_AFTER[vowel]
        out += [log(x) for x in (lower * v, lower * (1 - v), upper * v, upper * (1 - v), digit, sign)]
    return out


def _written(codes: str, chars: str, folded: str) -> str:
    """SQL for the log probability of a written token: of its states, and of each character in its state."""
    vowels = sum(LETTER_SHARES[c] for c in VOWELS)
    rest = sum(LETTER_SHARES.values()) - vowels
    share = {c: x / (vowels if c in VOWELS else rest) for c, x in LETTER_SHARES.items()} | dict.fromkeys("0123456789", 0.1) | SIGN_SHARES
    array = lambda xs: "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"
    step = f"if({folded}, get({array(_steps(True))}, a * 6 + b), get({array(_steps(False))}, a * 6 + b))"
    states = f"aggregate(zip_with(concat(array(6), slice({codes}, 1, size({codes}) - 1)), {codes}, (a, b) -> {step}), 0D, (t, y) -> t + y)"
    emitted = f"aggregate({chars}, 0D, (t, c) -> t + get({array(log(x) for x in share.values())}, locate(c, {_sql(''.join(share))}) - 1))"
    return f"{states} + {emitted}"


def battery(df: DataFrame, name: str) -> DataFrame:
    """Replace the array ``name`` of (start, stop, s) by (start, stop, cls, p, w): the p-value of randomness and the
    log of the e-value against written tokens."""
    case = lambda k: "case " + " ".join(f"when x.s rlike {_sql(p[0])} then {v}" for p in _ENCODINGS for v in [_sql(p[1]) if k == "alphabet" else p[2]]) + " end"
    characters, states = _states()
    one_case = " or ".join(f"x.s rlike {_sql(_ENCODINGS[i][0])}" for i in range(3))
    split = lambda text: f"filter(split({text}, ''), c -> c <> '')"
    arrays = (
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 's', rtrim('=', x.s)))",
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 's', {case('token')}, 'a', {case('alphabet')}, 'f', {one_case}, 'o', x.s))",
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 's', x.s, 'a', x.a, 'f', x.f, 'c', {split('lower(x.o)')}, "
        f"'k', transform({split(f'translate(if(x.f, lower(x.o), x.o), {_sql(characters)}, {_sql(states)})')}, c -> int(c))))",
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 's', x.s, 'a', x.a, 'w', -length(x.s) * ln(length(x.a)) - ({_written('x.k', 'x.c', 'x.f')})))",
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 'w', x.w, 'n', double(length(x.s)), 'm', double(length(x.a)), 'v', transform(filter(split(x.s, ''), c -> c <> ''), c -> double(locate(c, x.a) - 1))))",
        # sums: squared counts, high half, changes of half, mean
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 'w', x.w, 'n', x.n, 'm', x.m, 'v', x.v, "
        "'q', aggregate(array_distinct(x.v), 0D, (t, c) -> t + power(double(size(filter(x.v, y -> y = c))), 2)), "
        "'h', double(size(filter(x.v, y -> y >= x.m / 2))), "
        "'r', double(1 + size(filter(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v)), (a, b) -> (a >= x.m / 2) <> (b >= x.m / 2)), y -> y))), "
        "'mu', aggregate(x.v, 0D, (t, y) -> t + y) / x.n))",
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 'w', x.w, 'n', x.n, 'm', x.m, 'q', x.q, 'h', x.h, 'r', x.r, "
        "'e', 2 * x.h * (x.n - x.h) / x.n + 1, "
        "'ss', aggregate(x.v, 0D, (t, y) -> t + (y - x.mu) * (y - x.mu)), "
        "'sc', aggregate(zip_with(slice(x.v, 1, size(x.v) - 1), slice(x.v, 2, size(x.v)), (a, b) -> (a - x.mu) * (b - x.mu)), 0D, (t, y) -> t + y)))",
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 'w', x.w, 'n', x.n, "
        "'zc', greatest(0D, (x.m / x.n * x.q - x.n - (x.m - 1)) / sqrt(2 * (x.m - 1) * (x.n - 1) / x.n)), "
        "'zr', if(x.e <= 2, sqrt(x.n), (x.r - x.e) / sqrt((x.e - 1) * (x.e - 2) / (x.n - 1))), "
        "'zs', if(x.ss = 0, x.n, (x.sc / x.ss + 1 / x.n) * sqrt(x.n))))",
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 'w', x.w, 'n', x.n, 'y', -{_normal_tail('x.zc')} - {_normal_tail('x.zr')} - {_normal_tail('x.zs')}))",
        f"transform({name}, x -> named_struct('start', x.start, 'stop', x.stop, 'cls', {' + '.join(f'int(x.n >= {n})' for n in LENGTHS)}, "
        "'p', greatest(1e-300D, exp(-x.y) * (1 + x.y + x.y * x.y / 2)), 'w', x.w))",
    )
    for step in arrays:
        df = df.withColumn(name, F.expr(step))
    return df


def cutoffs(candidates: DataFrame) -> dict[int, int]:
    """The least p-value bin (of -log2 p in quarters) that departs from
    randomness, for each length class: Benjamini-Hochberg over (cls, bin, n)."""
    rows: dict[int, dict[int, int]] = {}
    for cls, b, n in candidates.collect():  # at most len(LENGTHS) * (BINS + 1) rows
        rows.setdefault(cls, {})[b] = n
    out = {}
    for cls, bins in rows.items():
        total, below, cut = sum(bins.values()), 0, BINS + 1
        for b in sorted(bins, reverse=True):  # from the smallest p-values up
            below += bins[b]
            if 2.0 ** (-b / 4) <= Q * below / total:
                cut = b
        out[cls] = cut
    return out


def report_cutoffs(candidates: DataFrame) -> dict[int, int]:
    """The least e-value bin (of log2 e in quarters) that is reported, for each length class, over (cls, bin, n); bin -1
    holds those without evidence. A bin counts as its lower end."""
    rows: dict[int, dict[int, int]] = {}
    for cls, b, n in candidates.collect():  # at most len(LENGTHS) * (BINS + 2) rows
        rows.setdefault(cls, {})[b] = n
    out = {}
    for cls, bins in rows.items():
        total, above, cut = sum(bins.values()), 0, BINS + 1
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            above += bins[b]
            if 2.0 ** (b / 4) * FALSE_REPORTS * above >= total:
                cut = b
        out[cls] = cut
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, assign, access, hex, random): arrays of spans (start, stop)."""
    scratch = scratch or Scratch(docs.sparkSession)
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    value = f"length(regexp_extract(x.s, {_sql(ASSIGN)}, 2)) >= {ASSIGN_LEAST}"
    df = _matches(df, "assign", ASSIGN, value)
    # a shorter run fails whole, so asking for the length in the pattern drops the same matches
    df = _matches(df, "access", f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", "true")
    df = _matches(df, "hex", f"[0-9a-f]{{{HEX_LEAST},}}", "true")
    df = _matches(df, "random", CANDIDATE, "x.s rlike '[0-9]' and x.s rlike '[A-Za-z]'").drop("__text")
    for kind in KINDS[:3]:
        df = df.withColumn(kind, F.expr(f"transform({kind}, x -> struct(x.start, x.stop))"))
    # the battery runs on the candidates alone, in a stage of its own
    found = scratch.write(battery(scratch.write(df, "spans"), "random"), "secrets")
    bin_of = f"int(least({BINS}, floor(-log2(x.p) * 4)))"
    histogram = found.select(F.explode("random").alias("x")).groupBy(F.col("x.cls").alias("cls"), F.expr(bin_of).alias("b")).agg(F.count("*").alias("n"))
    kept = " or ".join(f"(x.cls = {cls} and {bin_of} < {b})" for cls, b in sorted(cutoffs(histogram).items())) or "false"
    evidence = f"if(({kept}) and x.w >= 0, int(least({BINS}, floor(x.w / ln(2D) * 4))), -1)"
    histogram = found.select(F.explode("random").alias("x")).groupBy(F.col("x.cls").alias("cls"), F.expr(evidence).alias("b")).agg(F.count("*").alias("n"))
    accepted = " or ".join(f"(x.cls = {cls} and {evidence} >= {b})" for cls, b in sorted(report_cutoffs(histogram).items())) or "false"
    apart = " and ".join(f"not exists({k}, y -> y.start < x.stop and x.start < y.stop)" for k in KINDS[:3])
    return found.withColumn("random", F.expr(f"transform(filter(random, x -> ({accepted}) and {apart}), x -> struct(x.start, x.stop))"))


def render(spans: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the spans as text."""

    def text(kinds: tuple[str, ...]) -> str:
        parts = ", ".join(f"transform({k}, x -> struct(x.start as start, {i} as kind, x.stop as stop))" for i, k in enumerate(KINDS) if k in kinds)
        names = ", ".join(f"'{k}'" for k in KINDS)
        return f"array_join(transform(array_sort(concat({parts})), x -> concat(get(array({names}), x.kind), ':', x.start, ':', x.stop)), ',')"

    counts = {f"n_{k}": F.expr(f"cast(size({k}) as bigint)") for k in KINDS[:3]}
    return spans.withColumns(counts | {"base_sha256": F.sha2(F.expr(text(KINDS[:3])), 256), "spans": F.expr(text(KINDS))})
