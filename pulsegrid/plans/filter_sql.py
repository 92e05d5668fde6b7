"""SQL of the filters over the table of embeddings, independent of the kernels.

Sections of Butterworth filters come from closed formulas by their quality factors (low and high pass) or from the roots of
the transformed prototype (band pass), all evaluated by the database; a filter is a recursion over the instants of each lead,
run once forward and once backward over its odd extension.
"""

from __future__ import annotations

import math

Step = tuple  # ("low" | "high", cut-off, order), ("band", low, high, order) or ("notch", frequency, quality)


def _sections(step: Step, fs: float) -> tuple[list[str], int]:
    """(select lists of b0, b1, b2, a1, a2 of each section, samples of the extension at each end)."""
    kind = step[0]
    if kind == "notch":
        w = f"(2 * pi() * {step[1]} / {fs})"
        g = f"(1 / (1 + tan({w} / {step[2]} / 2)))"
        return [f"{g} AS b0, -2 * {g} * cos({w}) AS b1, {g} AS b2, -2 * {g} * cos({w}) AS a1, 2 * {g} - 1 AS a2"], 9
    if kind in ("low", "high"):
        cutoff, order = step[1:]
        t = f"tan(pi() * {cutoff} / {fs})"
        out = []
        for k in range(order // 2):
            q = f"(2 * sin({(2 * k + 1)} * pi() / {2 * order}))"  # the inverse of the quality factor
            n = f"(1 / (1 + {t} * {q} + {t} * {t}))"
            b = f"{t} * {t} * {n} AS b0, 2 * {t} * {t} * {n} AS b1, {t} * {t} * {n} AS b2" if kind == "low" else f"{n} AS b0, -2 * {n} AS b1, {n} AS b2"
            out.append(f"{b}, 2 * ({t} * {t} - 1) * {n} AS a1, (1 - {t} * {q} + {t} * {t}) * {n} AS a2")
        return out, 3 * (2 * len(out) + 1)
    low, high, order = step[1:]
    lo, hi = f"tan(pi() * {low} / {fs})", f"tan(pi() * {high} / {fs})"
    out = []
    for k in range(order // 2):
        s, c = f"sin({2 * k + 1} * pi() / {2 * order})", f"cos({2 * k + 1} * pi() / {2 * order})"
        for sign in (1, -1):
            out.append(
                f"(SELECT g AS b0, 0.0 AS b1, -g AS b2, a1, a2 FROM (SELECT *, sqrt((1 + a1 * cos(o) + a2 * cos(2 * o)) ^ 2 + (a1 * sin(o) + a2 * sin(2 * o)) ^ 2) / (2 * sin(o)) AS g FROM ("
                f"SELECT o, -2 * ((1 - x * x - y * y) / ((1 - x) ^ 2 + y * y)) AS a1, ((1 + x) ^ 2 + y * y) / ((1 - x) ^ 2 + y * y) AS a2 FROM ("
                f"SELECT o, hr + {sign} * sqrt(greatest(0, (m + re) / 2)) AS x, hm + {sign} * CASE WHEN im < 0 THEN -1 ELSE 1 END * sqrt(greatest(0, (m - re) / 2)) AS y FROM ("
                f"SELECT *, sqrt(re * re + im * im) AS m FROM (SELECT hr, hm, hr * hr - hm * hm - w AS re, 2 * hr * hm AS im, 2 * atan(sqrt(w)) AS o FROM ("
                f"SELECT -{s} * ({hi} - {lo}) / 2 AS hr, {c} * ({hi} - {lo}) / 2 AS hm, {hi} * {lo} AS w))))))) "
            )
    return out, 3 * (2 * len(out) + 1)


def _pass(name: str, source: str, sections: int) -> str:
    """Recursive CTE ``name`` over the lists ``xs`` of a source: the cascade from the steady state of the first value."""
    zero = ", ".join(f"(g{k} - b0_{k}) * lv{k} * xs[1] AS z1_{k}, (b2_{k} - a2_{k} * g{k}) * lv{k} * xs[1] AS z2_{k}" for k in range(sections))
    inner = f"SELECT p.*, xs[t + 1] AS y_in FROM {name} AS p WHERE t < len(xs)"
    for k in range(sections):
        y = "y_in" if k == 0 else f"w{k - 1}"
        inner = f"SELECT *, b0_{k} * {y} + z1_{k} AS w{k} FROM ({inner}) CROSS JOIN (SELECT b0_{k}, b1_{k}, b2_{k}, a1_{k}, a2_{k} FROM c)"
    news = ", ".join(f"b1_{k} * {'y_in' if k == 0 else f'w{k - 1}'} - a1_{k} * w{k} + z2_{k}, b2_{k} * {'y_in' if k == 0 else f'w{k - 1}'} - a2_{k} * w{k}" for k in range(sections))
    return (
        f"{name} AS (SELECT vec_id, 0 AS t, xs, CAST([] AS DOUBLE[]) AS ys, {zero} FROM {source}, c UNION ALL SELECT vec_id, t + 1, xs, list_append(ys, w{sections - 1}), {news} FROM ({inner}))"
    )


def zero_phase_sql(steps: list[Step], fs: float, digits: int) -> str:
    """The whole query: (vec_id, i, v)."""
    ctes = ["s0 AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS s FROM embeddings)"]
    for j, step in enumerate(steps):
        sections, pad = _sections(step, fs)
        parts = ", ".join(f"(SELECT b0 AS b0_{k}, b1 AS b1_{k}, b2 AS b2_{k}, a1 AS a1_{k}, a2 AS a2_{k}, (b0 + b1 + b2) / (1 + a1 + a2) AS g{k} FROM {x if x.startswith('(SELECT') else f'(SELECT {x})'})" for k, x in enumerate(sections))
        levels = ", ".join(" * ".join(["1.0", *[f"g{i}" for i in range(k)]]) + f" AS lv{k}" for k in range(len(sections)))
        own = lambda sql: sql.replace(" FROM c)", f" FROM c{j})").replace(", c UNION", f", c{j} UNION")  # noqa: B023, E731
        ctes.append(f"c{j} AS (SELECT *, {levels} FROM {parts})")
        ctes.append(f"e{j} AS (SELECT vec_id, list_concat([2 * s[1] - s[{pad} + 2 - q] FOR q IN range(1, {pad + 1})], s, [2 * s[-1] - s[len(s) - q] FOR q IN range(1, {pad + 1})]) AS xs FROM s{j})")
        ctes.append(own(_pass(f"f{j}", f"e{j}", len(sections))))
        ctes.append(f"r{j} AS (SELECT vec_id, list_reverse(ys) AS xs FROM f{j} WHERE t = len(xs))")
        ctes.append(own(_pass(f"k{j}", f"r{j}", len(sections))))
        ctes.append(f"s{j + 1} AS (SELECT vec_id, list_reverse(ys)[{pad + 1}:len(ys) - {pad}] AS s FROM k{j} WHERE t = len(xs))")
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT vec_id, CAST(unnest(range(0, len(s))) AS BIGINT) AS i, round(unnest(s), {digits}) + 0.0 AS v FROM s{len(steps)}"


def resample_sql(source: int, target: int, n: int) -> str:
    """Polyphase resampling of leads of n samples: each new sample is a sum over the old ones under a Kaiser window of beta 5."""
    g = math.gcd(source, target)
    up, down = target // g, source // g
    most = max(up, down)
    half = 10 * most
    bessel = lambda x: f"(SELECT sum((({x}) / 2) ^ (2 * j) / (gamma(j + 1) ^ 2)) FROM (SELECT unnest(range(0, 30)) AS j))"
    return (
        f"WITH h0 AS (SELECT m, CASE WHEN m = 0 THEN 1.0 ELSE sin(pi() * m / {most}) / (pi() * m / {most}) END * {bessel(f'5 * sqrt(greatest(0, 1 - (m / {half}.0) ^ 2))')} AS h FROM (SELECT unnest(range(-{half}, {half} + 1)) AS m)), "
        f"h AS (SELECT m, h * {up} / sum(h) OVER () AS h FROM h0), p AS (SELECT vec_id, unnest(range(0, len(embedding))) AS j, unnest([CAST(x AS DOUBLE) FOR x IN embedding]) AS x FROM embeddings), "
        f"o AS (SELECT unnest(range(0, {-(-n * up // down)})) AS i), w AS (SELECT i, m, (i * {down} - m) // {up} AS j, h FROM o CROSS JOIN h WHERE (i * {down} - m) % {up} = 0) "
        f"SELECT vec_id, CAST(i AS BIGINT) AS i, round(coalesce(sum(x * h), 0), 6) + 0.0 AS v FROM p JOIN w USING (j) GROUP BY vec_id, i"
    )


def segments_sql(size: int, step: int, window: str) -> str:
    """CTEs down to ``d`` (vec_id, segment g, bin k, psd): spectra of overlapping segments without their means, at 500 Hz."""
    taper = size / 8
    shape = f"0.5 - 0.5 * cos(2 * pi() * n / {size})" if window == "hann" else f"CASE WHEN least(n, {size} - n) < {taper} THEN 0.5 * (1 - cos(pi() * least(n, {size} - n) / {taper})) ELSE 1.0 END"
    return (
        f"WITH a AS (SELECT vec_id, unnest(range(0, (len(embedding) - {size}) // {step} + 1)) AS g, [CAST(x AS DOUBLE) FOR x IN embedding] AS s FROM embeddings), "
        f"b AS (SELECT vec_id, g, unnest(range(0, {size})) AS n, unnest(s[g * {step} + 1:g * {step} + {size}]) AS x FROM a), w AS (SELECT n, {shape} AS w FROM (SELECT unnest(range(0, {size})) AS n)), "
        f"c AS (SELECT vec_id, g, n, (x - avg(x) OVER (PARTITION BY vec_id, g)) * w AS y FROM b JOIN w USING (n)), "
        f"f AS (SELECT vec_id, g, k, sum(y * cos(2 * pi() * k * n / {size})) AS re, sum(y * sin(2 * pi() * k * n / {size})) AS im FROM c CROSS JOIN (SELECT unnest(range(0, {size // 2 + 1})) AS k) GROUP BY vec_id, g, k), "
        f"d AS (SELECT vec_id, g, k, (re * re + im * im) / (500 * (SELECT sum(w * w) FROM w)) * CASE WHEN k IN (0, {size // 2}) THEN 1 ELSE 2 END AS psd FROM f)"
    )
