"""SQL fragments for the comparison queries: tails and the signed-rank test."""


def normal_p(z: str) -> str:
    """Two-sided normal tail to six digits, by the all-positive series of erf."""
    x = f"(abs({z}) / sqrt(2))"
    term = f"exp(k * ln(2e0) + (2*k+1) * ln(greatest({x}, 1e-300)) - ((k+1) * ln(2e0) + lgamma(k + 1.5e0) - 0.5e0 * ln(pi())))"
    series = f"list_sum(list_transform(range(0, 160), lambda k: {term}))"
    return f"(case when abs({z}) > 6 then 0e0 else 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {series} end)"


def f_p(f: str, d1: str, d2: str, steps: int = 4000) -> str:
    """Upper F tail: the incomplete beta integral by Simpson's rule after u = sin^2."""
    a, b = f"({d2} / 2e0)", f"({d1} / 2e0)"
    top = f"asin(sqrt({d2} / ({d2} + {d1} * ({f}))))"
    g = f"pow(sin({top} * i / {steps}e0), 2 * {a} - 1) * pow(cos({top} * i / {steps}e0), 2 * {b} - 1)"
    w = f"(case when i = 0 or i = {steps} then 1 when i % 2 = 1 then 4 else 2 end)"
    s = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {w} * {g}))"
    return f"(2 * exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) * {top} / {steps}e0 / 3 * {s})"


EXACT_RANKS = """exact_sr(n, f) as (select 0, [1e0] union all
 select n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1),
  lambda i: (case when i < len(f) then f[i + 1] else 0 end) + (case when i >= n + 1 then f[i - n] else 0 end))
 from exact_sr where n < 49)"""


def signed_rank(src: str, keys: str) -> str:
    """CTEs ``wx`` (keys, n, v, z, p) testing column ``s`` of ``src``; NULL p where no value is nonzero."""
    z = "d - sign(d) * 0.5e0"
    return f"""{EXACT_RANKS},
wr as (select {keys}, s, count(*) over (partition by {keys}, abs(s)) as t,
 rank() over (partition by {keys} order by abs(s)) + (count(*) over (partition by {keys}, abs(s)) - 1) / 2e0 as r from {src} where s <> 0),
wz as (select {keys}, count(*) as n_all, count(*) filter (where s = 0) as n_zero from {src} group by {keys}),
ws as (select {keys}, count(*) as n, coalesce(sum(r) filter (where s > 0), 0) as v, max(t) as tmax,
 sum(cast(t as double) * t - 1) as ties from wr group by {keys}),
wd as (select *, v - n * (n + 1e0) / 4 as d, n * (n + 1e0) * (2 * n + 1) / 24 - ties / 48 as var from ws join wz using ({keys})),
wn as (select *, case when var > 0 then case when d = 0 then 0e0 else ({z}) / sqrt(var) end end as z from wd),
wx as (select w.*, case when w.n < 50 and n_zero = 0 and tmax = 1 then least(1, 2 * case
  when v > w.n * (w.n + 1) / 4e0 then 1 - list_sum(f[1:cast(v as int)]) / pow(2e0, w.n)
  else list_sum(f[1:cast(v as int) + 1]) / pow(2e0, w.n) end)
 else {normal_p('z')} end as p from wn w left join exact_sr e on e.n = w.n)"""


def _reml_at(points: str) -> str:
    """Per row ``id, a, b, c`` of ``points`` (factor of the random effects): criterion and estimates from table ``lev``."""
    q = lambda u1, u2, v1, v2: f"({u1} * {v1} * m22 - ({u1} * {v2} + {u2} * {v1}) * m12 + {u2} * {v2} * m11) / det"
    top, low, own = ("p1", "p2"), ("r1", "r2"), ("z1", "z2")
    return f"""select *, x00 * x11 - x01 * x01 as dx, (x11 * y0 - x01 * y1) / dx as b0, (x00 * y1 - x01 * y0) / dx as b1, yy - b0 * y0 - b1 * y1 as rss,
 rss / (total - 2) as s2, ld + ln(dx) as logs, (total - 2) * ln(s2) + logs as crit, x11 / dx as v00, -x01 / dx as v01, x00 / dx as v11 from
 (select id, a, b, c, sum(n) as total, sum(ln(det)) as ld, sum(n - {q(*top, *top)}) as x00, sum(sx - {q(*top, *low)}) as x01, sum(sxx - {q(*low, *low)}) as x11,
  sum(sy - {q(*top, *own)}) as y0, sum(sxy - {q(*low, *own)}) as y1, sum(syy - {q(*own, *own)}) as yy from ({_shrunk(points)}) group by id, a, b, c)"""


def _shrunk(points: str) -> str:
    return f"""select p.*, lev.*, n * a + sx * b as p1, sx * c as p2, sx * a + sxx * b as r1, sxx * c as r2, a * sy + b * sxy as z1, c * sxy as z2,
   1 + a * p1 + b * r1 as m11, a * p2 + b * r2 as m12, 1 + c * r2 as m22, m11 * m22 - m12 * m12 as det from ({points}) p, lev"""


def reml_fit(src: str, group: str, x: str, y: str, slope: bool) -> str:
    """CTEs ``mid`` (centre), ``lev`` (sums per level) and ``fit`` (factor and estimates), by a shrinking grid around the best point."""
    free = "abc" if slope else "a"
    grid = ", ".join(f"{p} + i{p}.range * h as {p}" if p in free else f"0e0 as {p}" for p in "abc")
    return f"""rows0 as (select {group} as g, cast({x} as double) as x, cast({y} as double) as y from {src} where {group} is not null and {x} is not null and {y} is not null),
mid as (select avg(x) as mx, avg(y) as my, stddev_samp(x) as sd from rows0),
lev as (select g, count(*) * 1e0 as n, sum(u) as sx, sum(u * u) as sxx, sum(v) as sy, sum(u * v) as sxy, sum(v * v) as syy
 from (select g, (x - mx) / sd as u, y - my as v from rows0, mid) group by g),
search(k, a, b, c, h) as (select 0, 0.5e0, 0e0, {'0.5e0' if slope else '0e0'}, 0.25e0 union all
 select id.k + 1, w.a, w.b, w.c, id.h * 0.7e0 from (select any_value(id) as id, arg_min({{'a': a, 'b': b, 'c': c}}, crit) as w from
  ({_reml_at(f"select {{'k': k, 'h': h}} as id, {grid} from search, " + ", ".join(f"range(-2, 3) i{p}" for p in free))})) where id.k < 60),
fit as ({_reml_at("select 0 as id, a, b, c from search where k = 60")})"""


def reml_tests(x: str, slope: bool, digits: dict[str, int]) -> str:
    """Fixed effects of ``fit`` with Satterthwaite's degrees of freedom, from difference quotients and a Cholesky factor."""
    free = "abc" if slope else "a"
    at = [("o", {})] + [(f"{p}{'m' if k < 0 else 'p'}{abs(k)}", {p: k}) for p in free for k in (-2, -1, 1, 2)]
    mixed = [(p, q) for i, p in enumerate(free) for q in free[i + 1:]]
    at += [(f"{p}{q}{'m' if u < 0 else 'p'}{'m' if v < 0 else 'p'}", {p: u, q: v}) for p, q in mixed for u in (-1, 1) for v in (-1, 1)]
    points = " union all ".join(f"select '{name}' as id, " + ", ".join(f"{p} + {m.get(p, 0)} * h{p} as {p}" for p in "abc") + " from steps" for name, m in at)
    wide = ", ".join(f"max({v}) filter (where id = '{name}') as {v}_{name}" for v in ("logs", "rss", "v00", "v01", "v11") for name, _ in at)
    first = lambda v, p: f"(8 * ({v}_{p}p1 - {v}_{p}m1) - ({v}_{p}p2 - {v}_{p}m2)) / (12 * h{p})"

    def second(v, p, q):
        if p == q:
            return f"(16 * ({v}_{p}p1 + {v}_{p}m1) - ({v}_{p}p2 + {v}_{p}m2) - 30 * {v}_o) / (12 * h{p} * h{p})"
        return f"({v}_{p}{q}pp - {v}_{p}{q}pm - {v}_{p}{q}mp + {v}_{p}{q}mm) / (4 * h{p} * h{q})"

    # Hessian over the parameters in order and the residual deviation s.
    names, hess = [*free, "s"], {}
    for i, p in enumerate(free):
        for q in free[i:]:
            hess[p, q] = f"{second('logs', p, q)} + {second('rss', p, q)} / s2"
        hess[p, "s"] = f"-2 * {first('rss', p)} / (s2 * sqrt(s2))"
    hess["s", "s"] = "4 * (total - 2) / s2"
    chain = []
    for j, q in enumerate(names):
        less = "".join(f" - l{q}{r} * l{q}{r}" for r in names[:j])
        chain.append(f"sqrt({hess[q, q]}{less}) as l{q}{q}")
        for p in names[j + 1:]:
            less = "".join(f" - l{p}{r} * l{q}{r}" for r in names[:j])
            chain.append(f"({hess[q, p]}{less}) / l{q}{q} as l{p}{q}")
    of = lambda expr: f"(w0 * w0 * {expr('v00')} + 2 * w0 * w1 * {expr('v01')} + w1 * w1 * {expr('v11')})"
    slopes = [f"s2 * {of(lambda v, p=p: '(' + first(v, p) + ')')} as g{p}" for p in free] + ["2 * sqrt(s2) * un as gs"]
    solved = [f"(g{p}" + "".join(f" - l{p}{r} * k{r}" for r in names[:j]) + f") / l{p}{p} as k{p}" for j, p in enumerate(names)]
    r = lambda c: f"round({c}, {digits.get(c, 6)}) as {c}"
    return f"""steps as (select a, b, c, """ + ", ".join(f"0.01e0 * greatest(1 / sqrt(nb), abs({p})) as h{p}" for p in "abc") + f""" from fit, (select avg(n) as nb from lev)),
around as (select {wide} from ({_reml_at(points)})),
chol as (select around.*, steps.* exclude (a, b, c), fit.b0, fit.b1, fit.s2, fit.total, mid.*, {', '.join(chain)} from around, steps, fit, mid),
terms as (select chol.*, t.*, {of(lambda v: v + '_o')} as un, {', '.join(slopes)}, {', '.join(solved)},
 my * w0 + b0 * w0 + b1 * w1 as estimate, sqrt(s2 * un) as std_error, s2 * un * s2 * un / ({' + '.join(f'k{p} * k{p}' for p in names)}) as df, estimate / std_error as statistic
 from chol, (select '(Intercept)' as term, 1e0 as w0, -mx / sd as w1 from mid union all select '{x}', 0e0, 1 / sd from mid) t)
select term, {r('estimate')}, {r('std_error')}, {r('df')}, {r('statistic')}, round({f_p('statistic * statistic', '1e0', 'df', 40_000)}, {digits.get('p_value', 6)}) as p_value from terms"""


REML_LINES = f"""lines as (select g, my + b0 + a * w1 as c0, b1 + b * w1 + c * w2 as c1, mx, sd from (select *, sy - n * b0 - sx * b1 as e1, sxy - sx * b0 - sxx * b1 as e2,
 a * e1 + b * e2 as f1, c * e2 as f2, (m22 * f1 - m12 * f2) / det as w1, (m11 * f2 - m12 * f1) / det as w2
 from ({_shrunk("select a, b, c, b0, b1 from fit")})), mid)"""
