"""Functions that DuckDB lacks, as SQL expressions."""

from __future__ import annotations

# Coefficients of the rational approximation of the normal quantile by Wichura (1988, AS 241).
CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)


def _polynomial(coefficients: tuple[float, ...], x: str) -> str:
    out = f"{coefficients[0]!r}::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


def probit_sql(p: str) -> str:
    """The normal quantile of p, for p from e^-25 to 1 - e^-25."""
    q = f"({p} - 0.5::double)"
    r = f"(0.180625::double - {q} * {q})"
    t = f"(sqrt(-ln(least({p}, 1 - {p})::double)) - 1.6::double)"
    centre, tail = (f"{_polynomial(a, x)} / {_polynomial(b, x)}" for (a, b), x in ((CENTRE, r), (TAIL, t)))
    return f"(case when abs({q}) <= 0.425 then {q} * {centre} else sign({q}) * {tail} end)"
