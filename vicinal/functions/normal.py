"""Poisson tails and normal quantiles as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# The coefficients of the Lanczos series for g = 7, and of the rational approximations of normal quantiles (algorithm AS 241) around 0.5, in the tails, and far out in them.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)
#: Terms of the series and steps of the fraction: some, and so many times the root of the larger argument.
TERMS, PER_ROOT = 80, 14


def log_gamma(x: Column) -> Column:
    """Of numbers of at least 1."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + k)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


def let(x: Column, of) -> Column:
    """of(x), x being worked out once however often it is used, also where the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(x), of), 1)


def log_tails(k: Column, mean: Column) -> Column:
    """A struct of low and up, the logarithms of the probabilities that a Poisson variable of a mean above 0 is at most k, and above k: each from what converges, the series of the incomplete Gamma function or its continued fraction."""
    return let(F.struct((k.cast("double") + 1).alias("a"), mean.cast("double").alias("x")), lambda v: _tails(v["a"], v["x"]))


def _tails(a: Column, x: Column) -> Column:
    steps, tiny, b = F.sequence(F.lit(1), (TERMS + PER_ROOT * F.sqrt(F.greatest(a, x))).cast("int")), 1e-300, lambda n: x + 2 * n + 1 - a
    guarded = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def term(z, n):
        return let(z["t"] * x / (a + n), lambda t: F.struct(t.alias("t"), (z["s"] + t).alias("s")))

    def step(z, n):  # the fraction by Lentz's way: its terms are n (a - n) over x + 2 n + 1 - a
        c, e = guarded(b(n) - n * (n - a) / z["c"]), guarded(b(n) - n * (n - a) * z["d"])
        return let(F.struct(c.alias("c"), (1 / e).alias("d")), lambda y: F.struct(y["c"].alias("c"), y["d"].alias("d"), (z["h"] * y["c"] * y["d"]).alias("h")))

    series = F.aggregate(steps, F.struct((1 / a).alias("t"), (1 / a).alias("s")), term, lambda z: z["s"])
    first = 1 / guarded(x + 1 - a)
    fraction = F.aggregate(steps, F.struct(F.lit(1 / tiny).alias("c"), first.alias("d"), first.alias("h")), step, lambda z: z["h"])
    other = lambda p: F.when(p < -40, F.lit(0.0)).otherwise(F.log(F.greatest(-F.expm1(p), F.lit(tiny))))
    part = let(a * F.log(x) - x - log_gamma(a), lambda f: F.struct(F.when(x < a + 1, f + F.log(series)).alias("u"), F.when(x >= a + 1, f + F.log(fraction)).alias("l")))
    return let(part, lambda t: F.struct(F.coalesce(t["l"], other(t["u"])).alias("low"), F.coalesce(t["u"], other(t["l"])).alias("up")))


def ratio(coefficients: tuple, r: Column) -> Column:
    top, bottom = (_poly(c, r) for c in coefficients)
    return top / bottom


def _poly(c: tuple, r: Column) -> Column:
    out = F.lit(c[-1])
    for x in reversed(c[:-1]):
        out = out * r + x
    return out


def quantile_of_log(p: Column) -> Column:
    """The normal quantile (0 at most) of a probability of at most 0.5, by its logarithm."""

    def nearer(z, _, p):  # beyond what the approximation is made for: the quantile solves the asymptotic series of the tail
        return let(1 / (z * z), lambda s: F.sqrt(F.greatest(-2 * p - F.log(2 * math.pi / s) + 2 * F.log(1 - s + 3 * s * s - 15 * s * s * s), F.lit(1.0))))

    def of(p, q, r):
        far = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.sqrt(-2 * p), lambda z, n: nearer(z, n, p))
        middle, tail, out = let(0.180625 - q * q, lambda y: ratio(MIDDLE, y)), let(r - 1.6, lambda y: ratio(TAIL, y)), let(r - 5, lambda y: ratio(FAR, y))
        return F.when(q >= -0.425, q * middle).when(r <= 5, -tail).when(r <= 27, -out).otherwise(-far)

    return let(p, lambda p: let(F.struct((F.exp(p) - 0.5).alias("q"), F.sqrt(-p).alias("r")), lambda v: of(p, v["q"], v["r"])))


def poisson_to_normal(observed: Column, expected: Column, most: float = 100.0) -> Column:
    """The normal quantile of the probability of at most `observed` under a Poisson law of mean `expected`, from -most to most; most where nothing is expected."""

    def z(t):
        q = quantile_of_log(F.least(t["low"], t["up"], F.lit(math.log(0.5))))
        return let(q, lambda q: F.greatest(F.lit(-most), F.least(F.lit(most), F.when(t["low"] <= t["up"], q).otherwise(-q))))

    return F.when(expected <= 0, F.lit(most)).otherwise(let(log_tails(observed, F.greatest(expected.cast("double"), F.lit(1e-300))), z))
